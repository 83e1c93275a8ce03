"""Combining sources to target shares of tokens (problem 8).

The mix is divided into equal blocks of tokens. Sainte-Lague's highest quotients allocate the blocks to the
sources by their shares, and each source's blocks to its shards by their tokens, which gives integer quotas.
A source whose quota exceeds its tokens is used in whole passes first. The documents of a shard lie in seeded
order and are cut into blocks of that many tokens, of which as many as its quota are selected, from the front.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import materialize, spread

#: Blocks of the whole mix, documents of a shard, and most shards of a source, which bound what the driver receives.
BLOCKS, SHARD_DOCUMENTS, SHARDS = 20_000, 10_000, 65_536
#: Texts that are encoded at a time by a vocabulary that gives more than numbers.
PORTION = 64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how a text falls into the parts that byte pairs are merged in.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space are beyond the library's stack and are taken part by part.
LONG_SPACE = 10_000


@lru_cache(maxsize=2)
def _counter(name: str, data: bytes):
    """A function from texts to their numbers of tokens."""
    if name.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        tokenizer.encode_special_tokens = True
        # Encodings are many times as large as their texts, so only some are held at a time.
        return lambda texts: [len(e) for at in range(0, len(texts), PORTION) for e in tokenizer.encode_batch_fast(texts[at : at + PORTION], add_special_tokens=False)]
    import regex
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    coder = tiktoken.Encoding(Path(name).stem, pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})
    parts, space = regex.compile(PARTS), re.compile(rf"\s{{{LONG_SPACE}}}")

    def one(text: str) -> int:
        if len(text) >= LONG_SPACE and space.search(text):
            return sum(len(coder._encode_single_piece(p.encode("utf-8", "replace"))) for p in parts.findall(text))
        return len(coder.encode_ordinary(text))

    return lambda texts: [one(t) for t in texts]


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text under a public tokenizer file; null counts 0.

    The file, of ranks (.tiktoken) or of a tokenizer (.json), is read where the driver runs; the tasks get its content.
    """
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from spanloom.llm.mixing import _counter

        counted = _counter(vocabulary, shared.value)
        for batch in batches:
            yield pd.Series(counted([t if isinstance(t, str) else "" for t in batch]), dtype="int64")

    return df.withColumn(name, F.pandas_udf(count, "long")(F.col(text)))


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats by highest quotients weight / (2 k + 1); ties go to the first key in order. A key never exceeds its cap."""
    out = dict.fromkeys(weights, 0)
    exact = {k: Fraction(w) for k, w in weights.items() if w > 0}
    total = sum(exact.values())
    if not total:
        return out
    # Start at the lower quota, less one: no divisor method for these quotients gives fewer by much, and the rest is few steps.
    for k, w in exact.items():
        out[k] = max(0, min(int(w * seats / total) - 1, (caps or {}).get(k, seats)))
    heap = [(-w / (2 * out[k] + 1), k) for k, w in exact.items() if out[k] < (caps or {}).get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < (caps or {}).get(k, seats):
            heapq.heappush(heap, (-exact[k] / (2 * out[k] + 1), k))
    return out


def source_name(column: str):
    """A source's name without regard to letter case or stray spaces."""
    return F.lower(F.trim(F.col(column)))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of the mix.

    uses: doc_id, source, n_tokens, uses, one row a document used at least once. shares: source, target_share,
    share, n_tokens (with repeats), n_documents, most_uses, one row a listed source, also if it gives nothing.
    The size is ``total_tokens``, or the largest at which every listed source that has documents still gives its
    share within its ``max_repeats``. A listed source without documents gives nothing and its share is not made
    up by the others, so that theirs keep their proportions. Documents of unlisted or null sources, and those
    without tokens, are not used. Repeated deliveries of an id count once. Each source is within
    about one document of its quota.
    """
    wanted = {}
    for r in targets.where(F.col("source").isNotNull()).select(source_name("source").alias("s"), "target_share", "max_repeats").collect():
        share, repeats = wanted.get(r["s"], (0.0, 0))
        wanted[r["s"]] = (share + (r["target_share"] or 0.0), max(repeats, r["max_repeats"] or 0))
    spark = documents.sparkSession
    kept = spread(documents).select(F.col(doc_id).alias("doc_id"), source_name("source").alias("source"), F.col(text).alias("text")).where(F.col("source").isin(list(wanted)) & F.col("doc_id").isNotNull())
    counted = count_tokens(kept, "text", vocabulary).drop("text").where(F.col("n_tokens") > 0).dropDuplicates(["doc_id"])
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = materialize(counted.withColumn("_order", order), "mix-tokens")
    tokens, counts = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0)
    for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).collect():
        tokens[r["source"]], counts[r["source"]] = r["tokens"], r["documents"]
    able = {s: w for s, (w, m) in wanted.items() if w > 0 and tokens[s] and m > 0}
    most = min((tokens[s] * wanted[s][1] / w for s, w in able.items()), default=0)
    size = int(most if total_tokens is None else total_tokens)
    block = max(1, -(-size // blocks))
    given = sainte_lague({s: w for s, (w, _) in wanted.items()}, min(blocks, size))
    # What a source gives: whole passes, then the rest as blocks of its shards.
    quota = {s: min(given[s] * size / max(1, min(blocks, size)), tokens[s] * wanted[s][1]) if s in able else 0.0 for s in wanted}
    passes = {s: int(quota[s] // tokens[s]) if tokens[s] else 0 for s in wanted}
    rest = {s: quota[s] - passes[s] * tokens[s] for s in wanted}
    shards = {s: max(1, min(SHARDS, counts[s] // SHARD_DOCUMENTS)) for s in wanted}
    plan = F.broadcast(spark.createDataFrame([(s, shards[s], passes[s]) for s in wanted], "source string, _shards int, _passes int"))
    sharded = sized.join(plan, "source").withColumn("_shard", F.pmod("_order", F.col("_shards")).cast("int"))
    # At most SHARDS rows a listed source come to the driver.
    by_shard: dict[str, dict[int, int]] = {s: {} for s in wanted}
    for r in sharded.groupBy("source", "_shard").agg(F.sum("n_tokens").alias("tokens")).collect():
        by_shard[r["source"]][r["_shard"]] = r["tokens"]
    quotas: dict[tuple[str, int], int] = {}
    for s in wanted:
        seats = sainte_lague(dict(sorted(by_shard[s].items())), int(rest[s] // block), {k: -(-n // block) for k, n in by_shard[s].items()})
        quotas |= {(s, k): n * block for k, n in seats.items() if n}
    seen = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(sharded.withColumn("_middle", F.sum("n_tokens").over(seen) - F.col("n_tokens") / 2).select("doc_id", "source", "n_tokens", "_shard", "_passes", "_middle"), "mix-placed")

    def taken(of: dict[tuple[str, int], int]) -> DataFrame:
        """Documents whose middle lies within the selected blocks of their shard are used once more."""
        selected = spark.createDataFrame([(s, k, n) for (s, k), n in of.items()], "source string, _shard int, _quota long")
        return placed.join(F.broadcast(selected), ["source", "_shard"], "left").withColumn("_once", (F.col("_middle") <= F.coalesce("_quota", F.lit(0))).cast("int"))

    # Each shard is off by up to half a document, and blocks leave a rest; the shard with most to spare makes up for all.
    got = {(r["source"], r["_shard"]): r["n"] for r in taken(quotas).where("_once = 1").groupBy("source", "_shard").agg(F.sum("n_tokens").alias("n")).collect()}
    for s in wanted:
        if rest[s] >= 1 and by_shard[s]:
            off = round(rest[s] - sum(got.get((s, k), 0) for k in by_shard[s]))
            main = max(by_shard[s], key=lambda k: (by_shard[s][k] - got.get((s, k), 0) if off > 0 else got.get((s, k), 0), -k))
            quotas[s, main] = got.get((s, main), 0) + off
    uses = taken(quotas).withColumn("uses", (F.col("_passes") + F.col("_once")).cast("int")).where(F.col("uses") > 0).select("doc_id", "source", "n_tokens", "uses")
    listed = spark.createDataFrame([(s, float(w)) for s, (w, _) in sorted(wanted.items())], "source string, target_share double")
    given_now = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.count("*").alias("n_documents"), F.max("uses").alias("most_uses"))
    whole = Window.partitionBy()
    shares_ = listed.join(given_now, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_uses"])
    shares_ = shares_.withColumn("share", F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(whole)), F.lit(0.0)))
    return uses, shares_.select("source", "target_share", "share", "n_tokens", "n_documents", "most_uses")
