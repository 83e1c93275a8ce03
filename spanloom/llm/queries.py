"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm import credentials, handwritten, leakage, mixing, packing, parsing, shared_spans, splitting, stuffing, syntax
from spanloom.session import table


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "demo")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(_fragments(spark, sf)).select("fragment_id")


def p1_origins(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(_fragments(spark, sf)).select("fragment_id", F.array_join("origins", ",").alias("origins"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.find(_fragments(spark, sf)).select("fragment_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redacted(_fragments(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.invalid(_fragments(spark, sf)).select("fragment_id")


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.rates(_fragments(spark, sf))


def p3_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files that the rates of invalid ones are of."""
    return parsing.rates(_fragments(spark, sf)).select("repository", "language", "n_files")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    # The query is defined over records, so the classes are expanded here.
    pairs = shared_spans.expand(*shared_spans.shared_classes(_fragments(spark, sf)))
    return pairs.select(F.col("first").alias("fragment_a"), F.col("second").alias("fragment_b"))


def p4_extent(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.shared_extent(_fragments(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(_fragments(spark, sf))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_fragments(spark, sf))


def p5_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of each fragment without what they repeat, joined again, and whether all are within the limit."""
    new = F.expr("substring(piece_text, overlap_chars + 1)")
    pieces = splitting.split(_fragments(spark, sf)).select("fragment_id", "n_bytes", F.struct("piece", new.alias("t")).alias("p"))
    joined = pieces.groupBy("fragment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["t"]), "").alias("t"), F.max("n_bytes").alias("most"))
    return joined.select("fragment_id", F.sha2("t", 256).alias("digest"), (F.col("most") <= splitting.LIMIT).alias("within_limit"))


def p6_assign(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_fragments(spark, sf))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(_fragments(spark, sf))
    return packed.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_bytes").alias("used_bytes"))


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All fragments and bytes that were packed, and how many containers hold more than the capacity in several items."""
    held = p6_containers(spark, sf)
    overfull = F.count_if((F.col("used_bytes") > packing.CAPACITY) & (F.col("n_items") > 1))
    return held.agg(F.sum("n_items").alias("n_items"), F.sum("used_bytes").alias("n_bytes"), overfull.alias("overfull"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p7_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_uses(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each listed source keeps its repeats and, among those with documents, is within a hundredth of its share."""
    targets = table(spark, sf, "mix_targets")
    shares = mixing.mix(table(spark, sf, "documents"), targets)[1]
    most = targets.select(mixing.source_name("source").alias("source"), "max_repeats")
    there = F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(Window.partitionBy())
    near = F.when(F.col("n_tokens") > 0, F.abs(F.col("share") - F.col("target_share") / there) < 0.01).otherwise(F.col("share") == 0)
    told = shares.withColumn("near", near).join(most, "source")
    return told.select("source", "target_share", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), F.col("near").alias("near_target"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.stuffed(table(spark, sf, "documents"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stuffing.score(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name; of each problem the first is the one that is checked."""
    found = [
        p1_found, p1_origins, p2_found, p2_redacted, p3_found, p3_rates, p3_files, p4_found, p4_extent, p5_found, p5_pieces, p5_joined, p6_assign, p6_containers, p6_totals,
        p7_found, p7_alignments, p8_uses, p8_shares, p8_kept, p9_found, p9_scores,
    ]
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    def grams(key: str, name: str) -> str:
        words = f"SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name} WHERE text IS NOT NULL"
        return f"SELECT {key}, array_to_string(list_slice(w, k, k + 12), ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS k FROM ({words}))"

    language = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{name}'" for e, name in syntax.LANGUAGES.items()) + " END"
    return {
        "p3_files": f"""SELECT repository, language, count(*) AS n_files FROM (SELECT fragment_id, min(repository) AS repository, min({language}) AS language FROM (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM demo WHERE text IS NOT NULL) GROUP BY 1)
 WHERE language IS NOT NULL GROUP BY ALL""",
        "p5_joined": "SELECT DISTINCT fragment_id, sha256(text) AS digest, true AS within_limit FROM demo WHERE octet_length(encode(text)) > 6144",
        "p6_totals": "SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS overfull FROM (SELECT fragment_id, max(coalesce(octet_length(encode(text)), 0)) AS n FROM demo GROUP BY 1)",
        "p8_kept": "SELECT lower(trim(source)) AS source, target_share, true AS within_repeats, true AS near_target FROM mix_targets",
        "p5_found": "SELECT DISTINCT fragment_id FROM demo WHERE octet_length(encode(text)) > 6144",
        "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({grams('doc_id', 'documents')}) JOIN ({grams('item_id', 'benchmark')}) USING (gram)",
    }
