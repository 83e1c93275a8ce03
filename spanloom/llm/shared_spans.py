"""Long exact stretches that records of different groups have in common (problem 4).

A corpus is never compared with a broadcast of itself. Minimizers route it instead: of all substrings of
``ANCHOR`` characters, those with the least hash in some window are anchors, and the windows are so long that
every stretch of ``least`` characters holds an anchor wherever it stands. Only texts that share an anchor with
another group are looked at further. Each such text is a reference shard: a suffix automaton of its shared
neighbourhoods is built, and the texts that meet it stream through it for their matching statistics, which
give the maximal spans, exactly. Equal texts are one class and meet others once. What many texts have in common is
told by two hashes of all its characters instead, and their pairs meet in parts.

Positions and lengths are in code points, line ends included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import materialize, spread

LEAST, ANCHOR = 240, 120
#: An anchor at more places than this is replaced by all hashes of ``least`` characters around it, and so many classes meet in one part.
HOT = 200
#: Characters hashed at a time, and words of 64 bits in a map of keys, which is all that is ever broadcast, whatever the input.
BATCH, MAP_WORDS = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(2**64 - 1)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BATCH, np.uint64(pow(_BASE, -1, 2**64)))]), dtype=np.uint64)
_FORWARD = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BATCH, np.uint64(_BASE))]), dtype=np.uint64)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every substring of ``n`` code points of at most BATCH code points."""
    terms = (codes.astype(np.uint64) + np.uint64(1)) * _INVERSE[: len(codes)]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    h = (sums[n:] - sums[:-n]) * _FORWARD[: len(codes) - n + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``best`` over each window of ``width`` values."""
    n = len(values)
    rows = np.full(-(-n // width) * width, fill, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[str], least: int = LEAST, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of texts with at least ``least`` characters.

    Two equal stretches of ``least`` characters hold the same anchors at the same offsets: within each of its
    windows all positions of least hash are taken.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = least - size + 1
    group: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        codes = np.concatenate([c for _, _, c in group])
        lengths = np.array([len(c) for _, _, c in group])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = gram_hashes(codes, size)
        low = _sliding(h, width, np.minimum, _TOP)
        # A window that reaches into the next text has no least hash.
        for end in starts[1:]:
            low[max(0, end - least + 1) : end] = 0
        pad = np.zeros(width - 1, np.uint64)
        top = _sliding(np.concatenate([pad, low, pad]), width, np.maximum, np.uint64(0))
        at = np.flatnonzero((top == h) & (top > 0))
        k = np.searchsorted(starts, at, side="right") - 1
        out.append((np.array([i for i, _, _ in group])[k], at - starts[k] + np.array([b for _, b, _ in group])[k], h[at]))
        group.clear()

    held = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < least:
            continue
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        # A text beyond a batch is taken in parts that overlap by least - 1, so that no window is missing.
        for begin in range(0, max(1, len(codes) - least + 1), BATCH - least + 1):
            part = codes[begin : begin + BATCH]
            if held + len(part) > BATCH and group:
                flush()
                held = 0
            group.append((i, begin, part))
            held += len(part)
    if group:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class SuffixAutomaton:
    """Suffix automaton of several strings; a match never crosses from one into the next."""

    def __init__(self, parts: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for part in parts:
            last = 0
            for c in part:
                last = self._extend(last, c)

    def _extend(self, last: int, c: str) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: str, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = copy
            p = link[p]
        return copy

    def spans(self, text: str, least: int, first: bool = False) -> list[tuple[int, int]]:
        """The maximal stretches [start, end) of ``text`` that stand in a part and have at least ``least`` characters."""
        nexts, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        state = n = 0
        begun = False
        for i, c in enumerate(text):
            to = nexts[state].get(c)
            if to is None:
                if begun:
                    out.append((i - n, i))
                    begun = False
                while state != -1 and c not in nexts[state]:
                    state = link[state]
                if state == -1:
                    state = n = 0
                    continue
                n = length[state] + 1
                state = nexts[state][c]
            else:
                state = to
                n += 1
            if n >= least:
                begun = True
                if first:
                    return [(i + 1 - n, i + 1)]
        if begun:
            out.append((len(text) - n, len(text)))
        return out


def neighbourhoods(length: int, positions: list[int], least: int, size: int) -> list[tuple[int, int]]:
    """The parts of a text around its shared anchors in which every shared stretch of ``least`` lies wholly.

    A stretch goes on as long as anchors follow one another, so parts that touch are one part; what lies outside
    of the first and last window of a run of anchors is beyond every stretch that those anchors find.
    """
    out: list[list[int]] = []
    for p in sorted(positions):
        a, b = max(0, p - (least - size)), min(length, p + least)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _map_of(keys: DataFrame) -> Broadcast:
    """A bit for each value of the long column ``h``, in MAP_WORDS words; values share bits, so it tells only what is surely absent."""
    bit = F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))")
    told = keys.groupBy(F.pmod("h", F.lit(MAP_WORDS)).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    words = np.zeros(MAP_WORDS, np.int64)
    words[told["w"].to_numpy(np.int64)] = told["b"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(words)


def _may_be_in(keys: Broadcast, h: Column) -> Column:
    """Whether a long may be among the keys of a map; what is not needs no shuffle."""

    def test(h: pd.Series) -> pd.Series:
        values = h.to_numpy(np.int64)
        return pd.Series((keys.value[values % MAP_WORDS] >> ((values >> 32) & 63)) & 1 > 0)

    return F.pandas_udf(test, "boolean")(h)


def members(df: DataFrame, key: str, group: str, text: str, least: int) -> DataFrame:
    """Each record once with its class: member, of (its group), class, low and high (least and greatest group of the class).

    A class is named by the least key among equal texts, which are told by 128 bits of hash and the length.
    """
    one = df.where((F.length(F.col(text)) >= least) & F.col(key).isNotNull()).select(
        F.col(key).alias("member"), F.col(group).alias("of"), F.xxhash64(F.col(text)).alias("_x"), F.xxhash64(F.lit(1), F.col(text), F.length(F.col(text))).alias("_y")
    )
    one = materialize(one.groupBy("member").agg(F.min("of").alias("of"), F.min("_x").alias("_x"), F.min("_y").alias("_y")), "spans-members")
    classes = one.groupBy("_x", "_y").agg(F.min("member").alias("class"), F.min("of").alias("low"), F.max("of").alias("high"))
    return materialize(one.join(classes, ["_x", "_y"]).drop("_x", "_y"), "spans-classes")


def _met(rows: DataFrame, *hashes: str) -> DataFrame:
    """The hashes that records of several groups have; rows have low and high, the least and greatest group of theirs."""
    return rows.groupBy(*hashes).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi")).where("_lo <> _hi").select(*hashes)


def _shared_anchors(df: DataFrame, people: DataFrame, key: str, group: str, text: str, least: int, size: int) -> DataFrame:
    """The anchors of classes that other groups have too: class, low, high, at, h and before, the shared anchor ahead of it (0 for none)."""
    kind = df.schema[key].dataType.simpleString()
    of = df.schema[group].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, at, h = anchors(batch["t"].tolist(), least, size)
            yield pd.DataFrame({"k": batch["k"].to_numpy()[n], "low": batch["of"].to_numpy()[n], "at": at.astype(np.int32), "h": h.view(np.int64)})

    texts = spread(df).where((F.length(F.col(text)) >= least) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("of"), F.col(text).alias("t"))
    rows = materialize(texts.mapInPandas(find, f"k {kind}, low {of}, at int, h long"), "spans-anchors")
    met = materialize(_met(rows.withColumn("high", F.col("low")), "h"), "spans-met")
    rows = rows.where(_may_be_in(_map_of(met), F.col("h")))
    person = people.where(F.col("member") == F.col("class")).select("class", "low", "high")
    shared = rows.select(F.col("k").alias("class"), "at", "h").join(met, "h").join(person, "class")
    # Repeated deliveries of a record lie side by side here and count once.
    along = Window.partitionBy("class").orderBy("at", "h")
    marked = shared.withColumns({"_at": F.lag("at").over(along), "before": F.coalesce(F.lag("h").over(along), F.lit(0))})
    return materialize(marked.where(F.col("_at").isNull() | (F.col("_at") != F.col("at"))).select("class", "low", "high", "at", "h", "before"), "spans-shared")


def _exact(around: DataFrame, like: DataFrame, least: int, size: int) -> DataFrame:
    """Both hashes of every stretch of ``least`` characters around hot anchors: class, low, high, at, h, g, before (h of the stretch one ahead)."""
    names = ["class", "low", "high", "at", "h", "g", "before"]

    def closer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, low, high, at, n, parts in batch[["class", "low", "high", "hot", "n", "parts"]].itertuples(index=False):
                for a, b in neighbourhoods(n, list(at), least, size):
                    first, t = next((p["at"], p["t"]) for p in parts if p["at"] <= a and b <= p["at"] + len(p["t"]))
                    for begin in range(a, max(a + 1, b - least + 1), BATCH - least + 1):
                        codes = np.frombuffer(t[begin - first : min(b, begin + BATCH) - first].encode("utf-32-le", "surrogatepass"), np.uint32)
                        if len(codes) >= least:
                            h, g = gram_hashes(codes, least), gram_hashes(codes ^ np.uint32(0x5BD1E995), least)
                            before = np.concatenate([[0], h[:-1]]).astype(np.uint64)
                            yield pd.DataFrame({"class": c, "low": low, "high": high, "at": begin + np.arange(len(h)), "h": h.view(np.int64), "g": g.view(np.int64), "before": before.view(np.int64)})[names]

    kinds = {n: like.schema[n].dataType.simpleString() for n in names if n != "g"} | {"g": "long"}
    return around.mapInPandas(closer, ", ".join(f"{n} {kinds[n]}" for n in names))


def _meeting(rows: DataFrame, *hashes: str) -> DataFrame:
    """Pairs a < b of classes of different groups with a common hash, met at the first of a run of common ones.

    A hash of many classes is met in parts: each part of one side, of HOT classes or so, with the whole other side.
    """
    crowd = rows.groupBy(*hashes).agg(F.ceil(F.count("*") / HOT).cast("int").alias("_parts")).where("_parts > 1")
    salted = rows.join(crowd, list(hashes), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = salted.withColumn("_part", F.pmod(F.xxhash64("class"), F.col("_parts")).cast("int"))
    b = salted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    a, b = (side.select(F.col("class").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"), *hashes, "_part", F.col("before").alias(f"{x}_before")) for side, x in ((a, "a"), (b, "b")))
    apart = ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low")))
    begins = (F.col("a_before") != F.col("b_before")) | (F.col("a_before") == 0)
    return a.join(b, [*hashes, "_part"]).where((F.col("a") < F.col("b")) & apart & begins).select("a", "b").distinct()


def _parts(df: DataFrame, shared: DataFrame, key: str, text: str, least: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(parts of the classes' texts around their shared anchors, anchors that few classes have, exact stretches around the others or None)."""
    crowd = shared.groupBy("h").agg(F.count("*").alias("n"))
    hot = materialize(crowd.where(F.col("n") > HOT).select("h"), "spans-hot")
    wanted = shared.groupBy("class").agg(F.collect_list("at").alias("places"))
    kind = shared.schema["class"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, len(t), [{"at": a, "t": t[a:b]} for a, b in neighbourhoods(len(t), list(places), least, size)]) for c, t, places in batch[["class", "t", "places"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["class", "n", "parts"])

    named = _may_be_in(_map_of(wanted.select(F.xxhash64("class").alias("h"))), F.xxhash64(F.col(key)))
    whole = df.where(F.col(key).isNotNull() & named).select(F.col(key).alias("class"), F.col(text).alias("t")).join(wanted, "class").dropDuplicates(["class"])
    texts = materialize(whole.mapInPandas(cut, f"class {kind}, n int, parts array<struct<at:int,t:string>>"), "spans-texts")
    if hot.isEmpty():
        return texts, shared, None
    around = shared.join(hot, "h").groupBy("class", "low", "high").agg(F.collect_list("at").alias("hot")).join(texts, "class")
    exact = _exact(around, shared, least, size)
    exact = materialize(exact.join(_met(exact, "h", "g"), ["h", "g"]), "spans-exact")
    # What follows a hot anchor must meet by itself, since the hot one no longer names the pair.
    after = hot.select(F.col("h").alias("before"), F.lit(True).alias("_hot"))
    cool = shared.join(hot, "h", "left_anti").join(after, "before", "left")
    cool = cool.withColumn("before", F.when(F.col("_hot"), F.lit(0)).otherwise(F.col("before"))).select(*shared.columns)
    return texts, cool, exact


def _streamed(pairs: DataFrame, texts: DataFrame, kind: str, least: int, size: int, both: bool) -> DataFrame:
    """The pairs that share a stretch: a, b, the spans of b's text that stand in a's (in_b), and with ``both`` of a's in b's (in_a)."""
    left, right = (texts.select(F.col("class").alias(x), F.col("parts").alias(f"{x}_parts")) for x in "ab")
    # The second join leaves each shard's documents side by side; a crowded shard is split by the skew join.
    joined = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, shard = None, None
        for batch in batches:
            out = []
            for x, y, xp, yp in batch[["a", "b", "a_parts", "b_parts"]].itertuples(index=False):
                if shard is None or name != x:
                    name, shard = x, SuffixAutomaton([p["t"] for p in xp])
                found = []
                for p in yp:
                    found += [(p["at"] + s, p["at"] + e) for s, e in shard.spans(p["t"], least, not both)]
                    if found and not both:
                        break
                if found:
                    back = []
                    if both:
                        other = SuffixAutomaton([p["t"] for p in yp])
                        for p in xp:
                            back += [(p["at"] + s, p["at"] + e) for s, e in other.spans(p["t"], least)]
                    out.append((x, y, [{"s": s, "e": e} for s, e in merge(back)], [{"s": s, "e": e} for s, e in merge(found)]))
            yield pd.DataFrame(out, columns=["a", "b", "in_a", "in_b"])

    spans = "array<struct<s:int,e:int>>"
    return joined.mapInPandas(stream, f"a {kind}, b {kind}, in_a {spans}, in_b {spans}")


def shared_classes(df: DataFrame, least: int = LEAST, key: str = "fragment_id", group: str = "snapshot_id", text: str = "text", size: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership) of records of different groups with at least ``least`` consecutive characters in common.

    membership: member, of (its group), class, low, high; one row a record, equal texts being one class. pairs: a, b
    (a < b, classes by their least member), and a = b for a class whose copies lie in several groups. Null texts and
    keys, texts shorter than ``least`` and records of a null group are in neither. The rows are exact and distinct.
    """
    size = min(size, max(1, least // 2))
    known = df.where(F.col(group).isNotNull())
    people = members(known, key, group, text, least)
    shared = _shared_anchors(known, people, key, group, text, least, size)
    texts, cool, exact = _parts(known, shared, key, text, least, size)
    pairs = _streamed(_meeting(cool, "h"), texts, df.schema[key].dataType.simpleString(), least, size, False).select("a", "b")
    if exact is not None:
        # Two hashes of all ``least`` characters agree: these pairs need no reading.
        pairs = pairs.union(_meeting(exact, "h", "g")).distinct()
    copies = people.where((F.col("low") != F.col("high")) & (F.col("member") == F.col("class"))).select(F.col("class").alias("a"), F.col("class").alias("b"))
    return pairs.union(copies), people


def expand(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """The pairs of records of ``shared_classes``: first, second (first < second, of different groups)."""
    one = membership.select(F.col("class").alias("a"), F.col("member").alias("x"), F.col("of").alias("x_of"))
    two = membership.select(F.col("class").alias("b"), F.col("member").alias("y"), F.col("of").alias("y_of"))
    both = pairs.join(one, "a").join(two, "b").where((F.col("x_of") != F.col("y_of")) & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def shared_extent(df: DataFrame, least: int = LEAST, key: str = "fragment_id", group: str = "snapshot_id", text: str = "text", size: int = ANCHOR) -> DataFrame:
    """Of each record how many characters lie in stretches of ``least`` or more that other groups have too: key, n_chars, shared_chars.

    One row a key that is not null, 0 for null, short and unshared texts. Records of a null group share nothing. What
    many classes have is told by its hashes, so that no pair of a crowd is looked at.
    """
    size = min(size, max(1, least // 2))
    known = df.where(F.col(group).isNotNull())
    people = members(known, key, group, text, least)
    shared = _shared_anchors(known, people, key, group, text, least, size)
    texts, cool, exact = _parts(known, shared, key, text, least, size)
    pairs = materialize(_streamed(_meeting(cool, "h"), texts, df.schema[key].dataType.simpleString(), least, size, True), "spans-pairs")
    # A class of several groups is shared as a whole; the spans of the others are shared if the other side has another group.
    groups = people.where(F.col("member") == F.col("class")).select("class", "low", "high")
    sides = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), F.col("in_a").alias("spans")).union(pairs.select("b", "a", "in_b"))
    met = sides.join(groups.select("class", "low").where("low = high"), "class").join(groups.select(F.col("class").alias("other"), F.col("low").alias("_l"), F.col("high").alias("_h")), "other")
    flat = met.where((F.col("_l") != F.col("low")) | (F.col("_h") != F.col("low"))).select("class", F.explode("spans").alias("p")).select("class", "p.s", "p.e")
    if exact is not None:
        flat = flat.union(exact.where("low = high").select("class", F.col("at").alias("s"), (F.col("at") + least).alias("e")))
    # The union of intervals of one class: a gap opens where a span begins beyond all that came before.
    before = Window.partitionBy("class").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0))))
    covered = flat.withColumn("_new", fresh).groupBy("class").agg(F.sum("_new").cast("int").alias("_covered"))
    told = people.join(covered, "class", "left").select("member", (F.col("low") != F.col("high")).alias("_copied"), "_covered")
    base = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("member")).agg(F.max(F.coalesce(F.length(F.col(text)), F.lit(0))).alias("n_chars"))
    shared_chars = F.when(F.coalesce(F.col("_copied"), F.lit(False)), F.col("n_chars")).otherwise(F.coalesce(F.col("_covered"), F.lit(0)))
    return base.join(told, "member", "left").select(F.col("member").alias(key), "n_chars", shared_chars.alias("shared_chars"))
