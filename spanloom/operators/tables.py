"""The snapshot tables as the engine reads them: deliveries merged, captures selected, sizes summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as X


def first_delivery(df: DataFrame, key: str | list[str], by: str = "ingested_at") -> DataFrame:
    """Each record once, as it was first delivered; equal times are told apart by nothing else, since contents are equal."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last()))).where("_n = 1").drop("_n")


def least_row(df: DataFrame, keys: list[str], by: list[Column | str]) -> DataFrame:
    """One row a key, the least by ``by``, so that the same one stands however the table is partitioned."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def placed_deliveries(fragments: DataFrame) -> DataFrame:
    """Fragments once each, those of one file side in one partition, by a single shuffle of their texts.

    The number of partitions is given, since what follows costs computing more than data, and a window over keys that
    include the partitioning's needs no shuffle of its own.
    """
    n = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first_delivery(fragments.repartition(n, "snapshot_id", "path"), ["snapshot_id", "path", "fragment_id"])


def without_tests(file_evidence: DataFrame, fragments: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(evidence, fragments, patches, exclusions) without the records both of whose paths are tests.

    exclusions: snapshot_id, excluded, kept, warning for every snapshot that lost records.
    """
    tested = X.is_test_path(F.col("base.path")) & X.is_test_path(F.col("head.path"))
    marked = file_evidence.withColumn("_test", tested)
    gone = marked.where("_test")
    sides = gone.select("snapshot_id", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base.path").alias("path")), F.struct(F.lit("head").alias("side"), F.col("head.path").alias("path")))).alias("s")).select("snapshot_id", "s.side", "s.path").distinct()
    heads = gone.select("snapshot_id", F.col("head.path").alias("path")).distinct()
    counts = marked.groupBy("snapshot_id").agg(F.count_if("_test").alias("excluded"), F.count_if(~F.col("_test")).alias("kept")).where("excluded > 0")
    noun = F.when(F.col("excluded") == 1, "file").otherwise("files")
    warning = F.concat(F.lit("Excluded "), F.col("excluded").cast("string"), F.lit(" changed test "), noun, F.lit(" by default."))
    return (
        marked.where("not _test").drop("_test"),
        fragments.join(sides, ["snapshot_id", "side", "path"], "left_anti"),
        patches.join(heads, ["snapshot_id", "path"], "left_anti"),
        counts.withColumn("warning", warning),
    )


def source_bytes(fragments: DataFrame) -> DataFrame:
    """UTF-8 bytes and fragments of every snapshot."""
    return fragments.groupBy("snapshot_id").agg(F.sum(F.octet_length("text")).alias("source_bytes"), F.count("*").alias("n_fragments"))


def patch_bytes(patches: DataFrame) -> DataFrame:
    """UTF-8 bytes of patches of every snapshot; an unavailable patch has none."""
    return patches.groupBy("snapshot_id").agg(F.sum(F.octet_length(F.coalesce("patch", F.lit("")))).alias("patch_bytes"), F.count_if(F.col("patch").isNull()).alias("n_unavailable"))


def regions(fragments: DataFrame, file_evidence: DataFrame) -> DataFrame:
    """Base and head fragment of every region: snapshot_id, region, before_* and after_* (fragment_id, path, text, start_line, idx).

    A fragment without a region belongs to the one named by its record's head path.
    """
    heads = file_evidence.select("snapshot_id", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base.path").alias("path")), F.struct(F.lit("head").alias("side"), F.col("head.path").alias("path")))).alias("s"), F.col("head.path").alias("head_path"), F.col("base.path").alias("base_path")).select("snapshot_id", "s.side", "s.path", "head_path", "base_path")
    placed = fragments.join(heads.dropDuplicates(["snapshot_id", "side", "path"]), ["snapshot_id", "side", "path"]).withColumn("region", F.coalesce("region", "head_path"))
    packed = F.struct("fragment_id", "path", "text", "start_line", "idx", "scope")
    pairs = placed.groupBy("snapshot_id", "region").agg(
        F.first("head_path", True).alias("head_path"), F.first("base_path", True).alias("base_path"),
        F.max_by(F.when(F.col("side") == "base", packed), F.when(F.col("side") == "base", -F.col("idx"))).alias("before"),
        F.max_by(F.when(F.col("side") == "head", packed), F.when(F.col("side") == "head", -F.col("idx"))).alias("after"),
    )
    return pairs


def warnings_of(df: DataFrame, scope: str = "snapshot_id", text: str = "warning", by: str = "ord") -> DataFrame:
    """Distinct texts of each scope in the order they were first given."""
    firsts = df.groupBy(scope, text).agg(F.min(by).alias("_by"))
    return firsts.groupBy(scope).agg(F.transform(F.sort_array(F.collect_list(F.struct("_by", text))), lambda x: x[text]).alias("warnings"))
