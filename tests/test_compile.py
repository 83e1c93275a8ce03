import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import evidence, extract, match, tables
from spanloom.plans import compile as plan
from spanloom.sources import snapshots

DEF = "def {0}(x):\n    total = x + {1}\n    return total * 2\n"


def compiled(spark, before, after):
    t = snapshots.from_files(spark, before, after)
    return plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])


def kinds(c):
    s = F.coalesce("after", "before")
    return {(r.kind, r.path, r.name) for r in c.changes.select("kind", s["path"].alias("path"), s["name"].alias("name")).collect()}


@pytest.fixture(scope="module")
def example(spark):
    before = {
        "pkg/a.py": "import os\n\n\n" + DEF.format("keep", 1) + "\n\n" + DEF.format("gone", 2) + "\n\n" + DEF.format("moving", 3),
        "pkg/b.py": DEF.format("_private", 4) + "\n\n" + DEF.format("edited", 5),
        "notes.md": "one\ntwo\n",
    }
    after = {
        "pkg/a.py": "import os\nimport sys\n\n\n" + DEF.format("keep", 1) + "\n\n" + DEF.format("fresh", 99).replace("total", "sum_"),
        "pkg/b.py": DEF.format("renamed_thing", 4) + "\n\n" + DEF.format("edited", 6),
        "pkg/c.py": "from pkg.b import edited\n\n\n" + DEF.format("moving", 3) + "\n\ndef get_all():\n    return edited(moving(1))\n",
        "tests/test_c.py": "from pkg.c import get_all\n\n\ndef test_all():\n    assert get_all() == 1\n",
        "notes.md": "one\n2\n",
    }
    return compiled(spark, before, after)


def test_kinds_of_changes(example):
    got = kinds(example)
    assert ("moved", "pkg/c.py", "moving") in got
    assert ("renamed", "pkg/b.py", "renamed_thing") in got
    assert ("modified", "pkg/b.py", "edited") in got
    assert ("removed", "pkg/a.py", "gone") in got and ("added", "pkg/a.py", "fresh") in got
    assert ("added", "pkg/c.py", "get_all") in got
    assert ("wiring", "pkg/a.py", "module imports / context") in got
    assert ("text", "notes.md", "file context") in got
    assert not any(n == "keep" for _, _, n in got)


def test_edges_links_and_order(example):
    names = {r.symbol_id: r.name for r in example.symbols.collect()}
    edges = {(names[r.source], names[r.target], r.type) for r in example.symbol_edges.collect()}
    assert ("get_all", "edited", "calls") in edges and ("get_all", "moving", "calls") in edges and ("test_all", "get_all", "test_calls") in edges
    assert {r.status for r in example.test_links.collect()} == {"referenced, not run"}
    groups = {r.group_id: r for r in example.groups.collect()}
    assert sorted(g.number for g in groups.values()) == list(range(1, len(groups) + 1))
    for g in groups.values():
        for need in g.prerequisites:
            assert groups[need].number < g.number
    by_title = {g.title: g for g in groups.values()}
    assert by_title["Tests · test_c.py"].number > by_title["Orchestration · c.py"].number > by_title["Implementation · b.py"].number


def test_stats_and_patches(example):
    (s,) = example.stats.collect()
    assert s.supplied_paths == 5 and s.test_definitions == 1 and s.test_runs == 0 and s.identical_ast_moves == 1
    assert {r.residual.patch_status for r in example.raw_files.collect()} == {"captured"}


def test_absence_needs_whole_and_parsed_files(spark):
    t = snapshots.from_files(spark, {"a.py": DEF.format("f", 1)}, {"a.py": "x = (\n"})
    c = plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])
    rows = {r.kind: r for r in c.changes.collect()}
    assert "observed_base" in rows and "could not be parsed" in rows["observed_base"].basis and "removed" not in rows


def test_ambiguous_duplicates_stay_unpaired(spark):
    c = compiled(spark, {"a.py": DEF.format("f", 1), "b.py": DEF.format("f", 1)}, {"c.py": DEF.format("f", 1), "d.py": DEF.format("f", 1)})
    assert {k for k, _, n in kinds(c) if n == "f"} == {"added", "removed"}


def test_stages_remove_what_they_pair(spark):
    rows = [("base", "1", "a", "x"), ("head", "2", "a", "y"), ("base", "3", "b", "z"), ("head", "4", "c", "z"), ("head", "5", "c2", "z"), ("base", "6", None, "n"), ("head", "7", None, "n")]
    df = spark.createDataFrame([(1, *r) for r in rows], "snapshot_id long, side string, symbol_id string, k string, v string")
    pairs = match.unique_pairs(df, [F.col("k")])
    assert [(r.before, r.after) for r in pairs.collect()] == [("1", "2")]
    left = match.without(df, pairs)
    assert {r.symbol_id for r in left.collect()} == {"3", "4", "5", "6", "7"}
    assert {(r.before, r.after) for r in match.unique_pairs(left, [F.col("v")]).collect()} == {("6", "7")}


def test_extraction_cases():
    ok = extract.read_source("import a.b\nfrom . import c as d\n\n@deco\ndef f(x: int = g()):\n    'doc'\n    y = h.i(x)\n    assert y\n    with raises(E):\n        pass\n\nN: int = 1\nP = Q = 2\n", "m.py", None, 11)
    assert ok["status"] == "ok"
    f, n, p = ok["symbols"]
    assert (f["name"], f["start"], f["end"], f["doc"], f["signature"]) == ("f", 14, 20, "doc", "x: int=g()")
    assert [c["name"] for c in f["calls"]] == ["g", "h.i", "raises"] or {c["name"] for c in f["calls"]} == {"g", "h.i", "raises"}
    assert f["local_bindings"] == ["x", "y"] and f["assertions"] == ["assert y"] and f["raises"]
    assert (n["name"], p["name"]) == ("N", "P, Q")
    assert [(i["local"], i["module"], i["name"], i["level"], i["top_level"]) for i in ok["imports"]] == [("a", "a.b", None, 0, True), ("d", "", "c", 1, True)]
    nested = extract.read_source("try:\n    pass\nexcept E:\n    import a\nelse:\n    if x:\n        import b\nfinally:\n    import c\n", "m.py", None, 1)["imports"]
    assert [i["local"] for i in nested] == ["c", "a", "b"] and not any(i["top_level"] for i in nested)
    assert extract.read_source("x = 1\ry = 2\n", "m.py", None, 1)["status"] == "text_only"
    assert extract.read_source("x", "m.js", None, 1)["status"] == extract.read_source("x", "m.py", "text", 1)["status"] == "text_only"
    bad = extract.read_source("def (", "m.py", None, 1)
    assert bad["status"] == "failed" and bad["note"].startswith("AST unavailable: SyntaxError") and extract.read_source("", "m.py", None, 1)["symbols"] == []


def test_fingerprints_ignore_only_name_and_docstring():
    import ast

    def both(text):
        return extract.fingerprints(ast.parse(text).body[0])

    a, b = both("def f(x):\n    'doc'\n    return x\n"), both("def g(x):\n    return x\n")
    assert a[0] != b[0] and a[1] == b[1]
    assert both("def f(x):\n    return x\n")[1] != both("def f(y):\n    return y\n")[1]
    assert both("class A:\n    'only'\n")[1] == both("class B:\n    'other'\n")[1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.sampled_from([0, 60, 100_000]))
def test_ratios_are_those_of_matching_cell_by_cell(a, b, small):
    saved, match.SMALL_PAIR = match.SMALL_PAIR, small
    try:
        assert match.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
        assert (match.ratio(a, b, 0.4) >= 0.4) == (match.ratio(a, b) >= 0.4)
    finally:
        match.SMALL_PAIR = saved


def test_evidence_sides_and_coverage(spark):
    t = snapshots.from_files(spark, {"a.py": "", "b.py": "x"}, {"a.py": "y"})
    f = t["fragments"].withColumn("status", F.lit("ok"))
    rows = {(r.side, r.path): r for r in evidence.file_coverage(t["file_evidence"], f).collect()}
    assert rows["head", "b.py"].absent and rows["base", "a.py"].full_and_parsed and rows["base", "b.py"].counterpart_path == "b.py"


def test_deliveries_and_tests_are_set_aside(spark):
    t = snapshots.from_files(spark, {"tests/t.py": "a", "b.py": "x"}, {"tests/t.py": "b", "b.py": "y"})
    twice = t["fragments"].unionByName(t["fragments"])
    assert tables.first_delivery(twice, "fragment_id").count() == t["fragments"].count()
    e, f, p, gone = tables.without_tests(t["file_evidence"], t["fragments"], t["patches"])
    assert (e.count(), f.count(), p.count()) == (1, 2, 1)
    assert gone.first().warning == "Excluded 1 changed test file by default."


def test_rows_that_repeat_a_key_are_chosen_alike(spark):
    rows = [(1, "k", "b", None), (1, "k", "b", "x"), (1, "k", "a", "x"), (1, "j", "c", None)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "s int, k string, origin string, patch string").repartition(n)
        got = tables.least_row(df, ["s", "k"], [F.col("patch").asc_nulls_last(), "origin"])
        assert {(r.k, r.origin, r.patch) for r in got.collect()} == {("k", "a", "x"), ("j", "c", None)}


def test_empty_tables_compile(spark):
    t = snapshots.from_files(spark, {"a.py": "x"}, {"a.py": "x"})
    c = plan.compile_snapshots(*(t[n].limit(0) for n in ("fragments", "file_evidence", "patches")))
    assert c.changes.count() == c.groups.count() == c.symbol_edges.count() == 0


def test_ids_do_not_depend_on_partitions(spark):
    before, after = {f"m{i}.py": DEF.format(f"f{i}", i) for i in range(6)}, {f"m{i}.py": DEF.format(f"f{i}", i + 1) for i in range(6)}
    t = snapshots.from_files(spark, before, after)
    ids = [sorted(r.change_id for r in plan.compile_snapshots(t["fragments"].repartition(n), t["file_evidence"], t["patches"]).changes.collect()) for n in (1, 5)]
    assert ids[0] == ids[1]
