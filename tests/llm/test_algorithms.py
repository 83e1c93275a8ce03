"""Shared spans, splitting and packing against brute force, round trips and bounds."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import packing, shared_spans, splitting


# -- shared spans ----------------------------------------------------------------------------------
def grams(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def brute_pairs(rows, n):
    first = {}
    for k, g, t in rows:
        if k is not None and g is not None and t is not None:
            first.setdefault(k, (g, t))
    keys = sorted(first)
    sets = {k: grams(first[k][1], n) for k in keys}
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if first[a][0] != first[b][0] and sets[a] & sets[b]}


def brute_extent(rows, n):
    first = {}
    for k, g, t in rows:
        if k is not None:
            first.setdefault(k, (g, t or ""))
    out = {}
    for k, (g, t) in first.items():
        other = set().union(*[grams(u, n) for h, u in first.values() if g is not None and h is not None and h != g])
        covered = set()
        for i in range(len(t) - n + 1):
            if t[i : i + n] in other:
                covered.update(range(i, i + n))
        out[k] = (len(t), len(covered))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    letters = "abcdé🚀\n "
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 120))) for _ in range(60)]
    donor = "".join(rng.choices(letters, k=200))
    rows = []
    for i, t in enumerate(texts):
        if i % 3 == 0:
            a, n = rng.randrange(150), rng.choice([22, 23, 24, 25, 50])
            p = rng.randrange(len(t) + 1)
            t = t[:p] + donor[a : a + n] + t[p:]
        rows.append((f"k{i:03d}", i % 9, t))
    rows += [("k900", 1, texts[5]), ("k901", 2, texts[5]), ("k902", 5, texts[5]), ("k903", 1, None), ("k904", 3, ""), (None, 1, donor), ("k905", None, donor), ("k906", 2, "ab" * 300), ("k907", 4, "ba" * 200), ("k908", 6, "x" * 24), ("k909", 7, "x" * 23), ("k910", 8, "x" * 500)]
    return rows + rows[:7]


@pytest.mark.parametrize("hot", [200, 3, 1])
def test_pairs_and_extents_against_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    df = spark.createDataFrame(corpus, "fragment_id string, snapshot_id int, text string").withColumns({"class": F.lit("clash"), "h": F.lit(1)})
    got = [(r["first"], r["second"]) for r in shared_spans.expand(*shared_spans.shared_classes(df, 24)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(corpus, 24)
    want = brute_extent(corpus, 24)
    rows = {r.fragment_id: r for r in shared_spans.shared_extent(df, 24).collect()}
    assert {k: (r.n_chars, r.shared_chars) for k, r in rows.items()} == want


def test_empty_tables_share_nothing(spark):
    df = spark.createDataFrame([], "fragment_id string, snapshot_id int, text string")
    assert shared_spans.expand(*shared_spans.shared_classes(df)).count() == 0 and shared_spans.shared_extent(df).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.text("ab", max_size=40), st.integers(6, 20))
def test_equal_stretches_share_an_anchor(left, right, core, least):
    a, b = left + core, core + right
    rows = shared_spans.anchors([a, b], least, max(1, least // 2))
    mine = {0: set(), 1: set()}
    for i, _, h in zip(*rows):
        mine[int(i)].add(int(h))
    if grams(a, least) & grams(b, least):
        assert mine[0] & mine[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=4), st.text("abc", max_size=60), st.integers(1, 8))
def test_automaton_spans_are_maximal_and_complete(parts, text, least):
    spans = shared_spans.SuffixAutomaton(parts).spans(text, least)
    covered = {i for s, e in spans for i in range(s, e)}
    want = set()
    for i in range(len(text) - least + 1):
        if any(text[i : i + least] in p for p in parts):
            want.update(range(i, i + least))
    assert covered == want and all(any(text[s:e] in p for p in parts) for s, e in spans)


def test_batches_of_anchors_do_not_matter(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh", k=n)) for n in (0, 10, 500, 3000, 24, 25)] + [None]
    whole = {tuple(map(int, x)) for x in zip(*shared_spans.anchors(texts, 24, 12))}
    monkeypatch.setattr(shared_spans, "BATCH", 300)
    assert {tuple(map(int, x)) for x in zip(*shared_spans.anchors(texts, 24, 12))} == whole


# -- splitting --------------------------------------------------------------------------------------
PIECE = st.lists(st.sampled_from(["# head\n", "word word\n", "\n", "    indented\n", "}\r\n", "x" * 30, "é🚀" * 8, "def f():\n", "- item\n", "a;b;c," * 9]), max_size=60).map("".join)


@settings(max_examples=250, deadline=None)
@given(PIECE, st.sampled_from(["a.md", "a.py", None]), st.integers(24, 120), st.integers(0, 3))
def test_pieces_round_trip_within_the_limit(text, path, limit, overlap):
    pieces = splitting.split_text(text, path, limit, overlap)
    assert "".join(p[3] for p in pieces) == text
    before = ""
    for i, (line, n, repeated, new) in enumerate(pieces):
        whole = repeated + new
        assert len(whole.encode()) <= limit and (new or len(pieces) == 1)
        assert before.endswith(repeated) and n <= overlap
        assert line == (text[: len(text) - len("".join(p[3] for p in pieces[i:])) - len(repeated)]).count("\n")
        before += new


def test_three_lines_repeat_where_they_fit():
    text = "".join(f"line {i:03d} of the text\n" for i in range(200))
    pieces = splitting.split_text(text, "a.txt", 500)
    assert all(p[1] == 3 for p in pieces[1:]) and len(pieces) <= 1 + len(text) // 400
    markup = "".join(f"# H{i}\n" + "some words of prose\n" * 12 for i in range(20))
    assert all(p[3].startswith("# H") for p in splitting.split_text(markup, "a.md", 600, 0))


@settings(max_examples=250, deadline=None)
@given(PIECE, st.sampled_from(["a.md", "a.py"]), st.integers(60, 200))
def test_a_node_that_fits_is_never_cut(text, path, limit):
    lines = text.splitlines(keepends=True)
    rank, size = splitting.ranks(lines, path), [len(x.encode()) for x in lines]
    upto = [sum(size[:k]) for k in range(len(lines) + 1)]
    starts, at = set(), 0
    for _, _, _, new in splitting.split_text(text, path, limit):
        starts.add(at)
        at += new.count("\n") if new.endswith("\n") else len(lines)
    pieces = [*sorted(starts), len(lines)]

    def walk(a, b):
        if upto[b] - upto[a] <= limit:
            assert not any(a < s < b for s in starts), (a, b, starts)
        elif b - a > 1:
            for c in splitting.children(rank, a, b):
                walk(*c)

    if text.endswith("\n") and max(size) <= limit:
        walk(0, len(lines))
        # Neighbours that fit together, with the lines before them, are one piece.
        for a, b in zip(pieces, pieces[2:]):
            kept = max((upto[a] - upto[k] for k in range(max(0, a - 3), a) if upto[a] - upto[k] <= limit // 2), default=0)
            assert upto[b] - upto[a] + kept > limit


def test_sections_stay_whole():
    small, large = "# A\n" + "some words\n" * 12, "# B\n" + "and other words\n" * 48
    assert [p[3] for p in splitting.split_text(small + large, "a.md", 850)] == [small, large]
    code = "".join(f"# what f{k} does\n@cached\ndef f{k}():\n    x = {k}\n\n    return x\n\n" for k in range(40))
    assert all(p[3].startswith("# what") and p[3].endswith("return x\n\n") for p in splitting.split_text(code, "a.py", 300))


def test_rows_of_pieces(spark):
    rows = [("a", "a.py", "x = 1\n" * 3000, 7, 1), ("a", "a.py", "x = 1\n" * 3000, 7, 1), ("b", None, "é" * 9000, None, 1), ("c", "c", "x" * 6144, 1, 1), ("d", "d", None, 1, 1), ("e", "e", "", 1, 1)]
    df = spark.createDataFrame(rows, "fragment_id string, path string, text string, start_line int, piece int")
    out = splitting.split(df).orderBy("fragment_id", "piece").collect()
    assert {r.fragment_id for r in out} == {"a", "b"} and all(r.n_bytes <= 6144 for r in out)
    a = [r for r in out if r.fragment_id == "a"]
    assert [r.piece for r in a] == list(range(1, len(a) + 1)) and a[0].start_line == 7 and a[1].overlap_lines == 3
    assert a[1].start_line == 7 + a[0].piece_text.count("\n") - 3
    assert {r.fragment_id for r in splitting.oversized(df).collect()} == {"a", "b"} and splitting.split(df.limit(0)).count() == 0


# -- packing ----------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_plans_use_up_the_histogram(sizes):
    unique, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
    plan = packing.plan(unique, counts, 100, 4) if sizes else []
    used = {}
    for n, combination in plan:
        assert n > 0 and sum(s * k for s, k in combination.items()) <= 100
        for s, k in combination.items():
            used[s] = used.get(s, 0) + n * k
    assert used == dict(zip(unique.tolist(), counts.tolist()))
    halves = sum(1 for s in sizes if s > 50)
    assert sum(n for n, _ in plan) <= max(halves, -(-2 * sum(sizes) // 100) + 1)


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    sizes = np.minimum(8192, rng.lognormal(6.8, 0.9, 20_000).astype(np.int64) + 1)
    unique, counts = np.unique(sizes, return_counts=True)
    n = sum(k for k, _ in packing.plan(unique, counts))
    assert n <= 1.005 * (-(-int(sizes.sum()) // 8192)) + 1


def test_assignment(spark):
    rng = random.Random(2)
    rows = [(f"f{i}", "x" * rng.randrange(0, 90), i) for i in range(500)] + [("big", "y" * 500, 1), ("null", None, 1), ("uni", "é" * 40, 1), (None, "z", 1)]
    df = spark.createDataFrame(rows + rows[:20], "fragment_id string, text string, container int")
    out = packing.pack(df, 100).collect()
    assert len(out) == len(rows)
    load = {}
    for r in out:
        load.setdefault(r.container, []).append(r.n_bytes)
    assert all(sum(v) <= 100 or len(v) == 1 for v in load.values()) and sorted(load) == list(range(len(load)))
    # No worse than first fit of decreasing sizes, which is far from a histogram's shortcut but a known yardstick.
    bins = []
    for n in sorted((len((t or "").encode()) for _, t, _ in rows), reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= 100), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert len(load) <= len(bins)
    again = {r.fragment_id: r.container for r in packing.pack(df.repartition(5), 100).collect()}
    assert again == {r.fragment_id: r.container for r in out}
    assert packing.pack(df.limit(0)).count() == 0
    only = packing.pack(spark.createDataFrame([("a", ""), ("b", None)], "fragment_id string, text string")).collect()
    assert [r.container for r in only] == [0, 0]
