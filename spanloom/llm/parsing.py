"""Source files that are not valid in the language their path names (problem 3).

Texts up to ``LARGE`` characters are decided where they lie. Larger ones are cut into chunks of lines that go to
all tasks, each of which maps its chunks from every lexical state; the maps are composed in order, and only
texts whose composition is neutral are read by the grammar, and all of JavaScript and TypeScript, where the scan
may take a regular expression for a quote or bracket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import syntax
from spanloom.session import materialize, spread

LARGE, CHUNK = 4_000_000, 500_000


def language(path: Column) -> Column:
    """The language that a path names, or null; letter case does not matter."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name in dict.fromkeys(syntax.LANGUAGES.values()):
        out = F.when(ext.isin([e for e, x in syntax.LANGUAGES.items() if x == name]), F.lit(name)).otherwise(out)
    return out


def invalid(df: DataFrame, key: str = "fragment_id", path: str = "path", text: str = "text", large: int = LARGE, chunk: int = CHUNK) -> DataFrame:
    """Distinct key and language of the files whose whole text is not valid.

    Null texts and paths, and paths of other extensions, give no row. An empty text is valid in Python and in YAML, TOML,
    JavaScript and TypeScript, and invalid as JSON and Go. Repeated deliveries count once. Other columns are not carried.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df).select(F.col(key).alias("k"), language(F.col(path)).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("k").isNotNull())

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, l, t in batch.itertuples(index=False):
                if len(t) > large and l in syntax.STATES:
                    out += [(k, l, i, c) for i, c in enumerate(syntax.chunks(t, chunk))]
                elif not syntax.is_valid(t, l):
                    out.append((k, l, -1, None))
            yield pd.DataFrame(out, columns=["k", "l", "n", "c"])

    first = materialize(rows.mapInPandas(decide, f"k {kind}, l string, n int, c string"), "syntax")
    small = first.where(F.col("n") < 0).select("k", "l")
    parts = first.where(F.col("n") >= 0)
    if parts.isEmpty():
        return small.distinct().select(F.col("k").alias(key), F.col("l").alias("language"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, l, n, c in batch.itertuples(index=False):
                for state, s in syntax.state_map(c, l).items():
                    out.append((k, l, n, state, s.state, s.closes, s.opens, s.broken))
            yield pd.DataFrame(out, columns=["k", "l", "n", "before", "after", "closes", "opens", "broken"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        maps = [{r.before: syntax.Summary(r.after, r.closes, r.opens, bool(r.broken)) for r in g.itertuples()} for _, g in group.drop_duplicates(["n", "before"]).groupby("n")]
        s = reduce(syntax.compose, maps)["code"]
        return pd.DataFrame({"k": [group["k"].iloc[0]], "l": [group["l"].iloc[0]], "neutral": [s.state == "code" and not s.closes and not s.opens and not s.broken]})

    maps = parts.repartition("k", "n").mapInPandas(read, f"k {kind}, l string, n int, before string, after string, closes string, opens string, broken boolean")
    verdicts = maps.groupBy("k", "l").applyInPandas(fold, f"k {kind}, l string, neutral boolean")
    read_on = F.col("neutral") | F.col("l").isin(*syntax.CONFIRMED)
    unbalanced = verdicts.where(~read_on).select("k", "l")

    def grammar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, l) for k, l, t in batch.itertuples(index=False) if not syntax.is_valid(t, l)]
            yield pd.DataFrame(out, columns=["k", "l"])

    rest = rows.where(F.length("t") > large).join(verdicts.where(read_on).select("k"), "k", "left_semi")
    return small.union(unbalanced).union(rest.mapInPandas(grammar, f"k {kind}, l string")).distinct().select(F.col("k").alias(key), F.col("l").alias("language"))


def rates(df: DataFrame, key: str = "fragment_id", path: str = "path", text: str = "text", repository: str = "repository") -> DataFrame:
    """repository, language, n_files, n_invalid, rate; files without a repository are one group of null. A file counts once."""
    bad = invalid(df, key, path, text).select(F.col(key).alias("k"), F.lit(1).alias("bad"))
    files = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(repository).alias("repository"), language(F.col(path)).alias("language"))
    files = files.where(F.col("language").isNotNull()).groupBy("k").agg(F.min("repository").alias("repository"), F.min("language").alias("language"))
    counted = files.join(bad, "k", "left").groupBy("repository", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
    return counted.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
