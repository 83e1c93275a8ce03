"""Pairing declarations of two revisions in stages, each over what the earlier ones left.

A stage pairs only keys that exactly one declaration of each side has. That is one aggregation a stage: the two sides
are one table, and a key with one row of each carries its pair.
"""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import extract, tables
from spanloom.session import materialize

MIN_SIMILARITY = 0.40
#: Pairs of texts of up to so many cells are matched cell by cell.
SMALL_PAIR = 40_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
# What the pairs of the stages rest on, the last with its ratio.
STAGES = ("same declaration location", "unique name + identical AST", "unique declaration-name/docstring-normalized AST; internal names and literals preserved")

SIMILAR = "unique matching name (ignoring leading underscores)/type + AST-text similarity %.3f; candidate correspondence, not an equivalence proof"


def unique_pairs(rows: DataFrame, keys: list[Column], scope: str = "snapshot_id", side: str = "side", id_: str = "symbol_id", sides: tuple[str, str] = ("base", "head")) -> DataFrame:
    """scope, before, after of every key that exactly one row of each side has. Rows with a null key pair with none."""
    named = rows.select(F.col(scope), F.col(side).alias("_side"), F.col(id_).alias("_id"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    named = named.where(reduce(lambda a, b: a & b, (F.col(f"_k{i}").isNotNull() for i in range(len(keys)))))
    old, new = F.col("_side") == sides[0], F.col("_side") == sides[1]
    grouped = named.groupBy(scope, *[f"_k{i}" for i in range(len(keys))]).agg(
        F.count_if(old).alias("_o"), F.count_if(new).alias("_n"), F.max(F.when(old, F.col("_id"))).alias("before"), F.max(F.when(new, F.col("_id"))).alias("after")
    )
    return grouped.where((F.col("_o") == 1) & (F.col("_n") == 1)).select(scope, "before", "after")


def without(rows: DataFrame, pairs: DataFrame, scope: str = "snapshot_id", side: str = "side", id_: str = "symbol_id") -> DataFrame:
    """The rows of both sides that no pair has taken."""
    taken = pairs.select(F.col(scope), F.col("before").alias(id_)).withColumn(side, F.lit("base")).union(pairs.select(F.col(scope), F.col("after").alias(id_)).withColumn(side, F.lit("head")))
    return rows.join(taken, [scope, side, id_], "left_anti")


def _sums(codes: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common stretch; of equal ones the first in a, and of these the first in b.

    Whether there is one of a given length is told by the hashes of all stretches of that length, and the length is halved down to.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    p, q = _sums(x), _sums(y)
    shift = np.cumprod(np.full(max(len(x), len(y)) + 1, _INVERSE, np.uint64), dtype=np.uint64)

    def hashes(sums: np.ndarray, n: int) -> np.ndarray:
        return (sums[n:] - sums[:-n]) * shift[: len(sums) - n]

    least, most, best = 0, min(len(x), len(y)), (0, 0, 0)
    while least < most:
        n = (least + most + 1) // 2
        of_a, of_b = hashes(p, n), hashes(q, n)
        found = np.flatnonzero(np.isin(of_a, of_b))
        if len(found):
            i = int(found[0])
            least, best = n, (i, int(np.flatnonzero(of_b == of_a[i])[0]), n)
        else:
            most = n - 1
    i, j, n = best
    if a[i : i + n] != b[j : j + n]:
        raise ArithmeticError("hashes of different texts agree")
    return best


def matched_characters(a: str, b: str) -> int:
    """Characters in the longest common stretch of two texts, and so on in what lies before and behind it on both sides."""
    total, waiting = 0, [(a, b)]
    while waiting:
        a, b = waiting.pop()
        if len(a) * len(b) <= SMALL_PAIR:
            total += sum(block.size for block in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            continue
        i, j, n = longest_common(a, b)
        if n:
            total += n
            waiting += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Character ratio of two texts, twice the matched characters over all; any number below ``least`` stands for one below it."""
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    for bound in (matcher.real_quick_ratio, matcher.quick_ratio):
        # Both are upper bounds and cost far less than matching.
        if (known := bound()) < least:
            return known
    return 2.0 * matched_characters(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """``ratio`` of two text columns."""

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(v, w, least) for v, w in zip(x, y)], dtype="float64")

    return F.pandas_udf(each, "double")(a, b)


def _tree(text: Column, order: Column) -> Column:
    def each(texts: pd.Series, orders: pd.Series) -> pd.Series:
        return pd.Series([extract.tree(t, int(n)) for t, n in zip(texts, orders)], dtype="object")

    return F.pandas_udf(each, "string")(text, order)


def match_symbols(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """snapshot_id, stage (1 to 4), before, after, basis: the pairs of symbol ids of every snapshot.

    ``sources`` has the snapshot_id, fragment_id and text of the fragments; those of the last stage's candidates are parsed again.

    Stages: same path, name and type; same name and syntax tree; same tree but for a declaration's name and docstring;
    and, last, names alike but for leading underscores whose trees' texts are similar enough.
    """
    slim = materialize(
        symbols.select(
            "snapshot_id", "side", "symbol_id", "path", "name", "node_type", F.col("fingerprint").alias("exact"), F.col("rename_fingerprint").alias("alike"), "fragment_id", "ord",
        ).transform(tables.least_row, ["snapshot_id", "side", "symbol_id"], ["fragment_id", "ord"]),
        "match-symbols",
    )
    declared = F.col("node_type").isin("FunctionDef", "AsyncFunctionDef", "ClassDef")
    keys = ([F.col("path"), F.col("name"), F.col("node_type")], [F.col("name"), F.col("exact")], [F.when(declared, F.col("alike"))])
    left, found = slim, []
    for number, (key, basis) in enumerate(zip(keys, STAGES), 1):
        pairs = materialize(unique_pairs(left, key), f"match-{number}")
        found.append(pairs.select("snapshot_id", F.lit(number).alias("stage"), "before", "after", F.lit(basis).alias("basis")))
        left = without(left, pairs)
    bare = F.regexp_replace("name", "^_+", "")
    candidates = unique_pairs(left, [bare, F.col("node_type")])
    texts = sources.select("snapshot_id", "fragment_id", "text").dropDuplicates(["snapshot_id", "fragment_id"])
    rated = candidates
    for name, side in (("before", "base"), ("after", "head")):
        place = slim.where(F.col("side") == side).select("snapshot_id", F.col("symbol_id").alias(name), "fragment_id", "ord")
        rated = rated.join(place, ["snapshot_id", name]).join(texts, ["snapshot_id", "fragment_id"]).withColumn(f"_{name}", _tree(F.col("text"), F.col("ord"))).drop("fragment_id", "ord", "text")
    rated = rated.withColumn("ratio", similarity(F.col("_before"), F.col("_after"), MIN_SIMILARITY)).where(F.col("ratio") >= MIN_SIMILARITY)
    basis = F.format_string(SIMILAR, F.col("ratio"))
    found.append(rated.select("snapshot_id", F.lit(4).alias("stage"), "before", "after", basis.alias("basis")))
    return reduce(DataFrame.unionByName, found)
