"""What each file side shows: absent, unavailable or supplied, whole or in part, parsed or not.

Absence is a positive fact, unavailability proves nothing, and an empty file is supplied text; the three are told by an
explicit state and never by null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels


def evidence_sides(file_evidence: DataFrame) -> DataFrame:
    """One row a side of an evidence record: snapshot_id, rec_idx, side, path, state, coverage, reason, counterpart_path."""

    def side(name: str, other: str) -> Column:
        return F.struct(F.lit(name).alias("side"), *[F.col(f"{name}.{c}").alias(c) for c in ("path", "state", "coverage", "reason")], F.col(f"{other}.path").alias("counterpart_path"))

    return file_evidence.select("snapshot_id", "rec_idx", F.explode(F.array(side("base", "head"), side("head", "base"))).alias("s")).select("snapshot_id", "rec_idx", "s.*")


def file_coverage(file_evidence: DataFrame, fragments: DataFrame) -> DataFrame:
    """The evidence sides with their fragments in order: fragment_ids, parse_statuses, full_source, full_and_parsed, absent.

    ``fragments`` has snapshot_id, fragment_id, idx, side, path and status.
    """
    held = fragments.groupBy("snapshot_id", "side", "path").agg(F.sort_array(F.collect_list(F.struct("idx", "fragment_id", "status"))).alias("f"))
    joined = evidence_sides(file_evidence).join(held, ["snapshot_id", "side", "path"], "left")
    f = F.coalesce(F.col("f"), F.array().cast("array<struct<idx:int,fragment_id:string,status:string>>"))
    full = (F.col("state") == "supplied") & (F.coalesce("coverage", F.lit("")) == "full")
    statuses = F.transform(f, lambda x: x["status"])
    return joined.select(
        "snapshot_id", "rec_idx", "side", "path", "state", "coverage", "reason", "counterpart_path", F.transform(f, lambda x: x["fragment_id"]).alias("fragment_ids"), statuses.alias("parse_statuses"),
        full.alias("full_source"), (full & (statuses == F.array(F.lit("ok")))).alias("full_and_parsed"), (F.col("state") == "absent").alias("absent"),
    )


def definition_evidence(unmatched: DataFrame, symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """Kind, blockers and basis, in words, of every unmatched definition.

    It is added or removed only if its own file is whole and parsed, the counterpart is absent or whole and parsed, and no
    definition of its name and type remains there; else it is only observed on its side.
    """
    own = coverage.select("snapshot_id", "side", "path", "counterpart_path", F.struct("state", "coverage", "reason", "parse_statuses", "full_and_parsed", "absent").alias("own"))
    other = coverage.select("snapshot_id", F.when(F.col("side") == "base", "head").otherwise("base").alias("side"), F.col("path").alias("counterpart_path"), F.struct("state", "coverage", "reason", "parse_statuses", "full_and_parsed", "absent").alias("other"))
    there = symbols.select("snapshot_id", F.when(F.col("side") == "base", "head").otherwise("base").alias("side"), F.col("path").alias("counterpart_path"), "name", "node_type").distinct().withColumn("remains", F.lit(True))
    joined = (
        unmatched.join(own, ["snapshot_id", "side", "path"], "left")
        .join(other.dropDuplicates(["snapshot_id", "side", "counterpart_path"]), ["snapshot_id", "side", "counterpart_path"], "left")
        .join(there, ["snapshot_id", "side", "counterpart_path", "name", "node_type"], "left")
    )
    remains = F.coalesce(F.col("remains"), F.lit(False))
    confirmed = F.coalesce(F.col("own.full_and_parsed"), F.lit(False)) & F.coalesce(F.col("other.absent") | F.col("other.full_and_parsed"), F.lit(False)) & ~remains
    kind = F.when(confirmed & (F.col("side") == "base"), "removed").when(confirmed, "added").otherwise(F.concat(F.lit("observed_"), F.col("side")))

    def blockers(side: str) -> Column:
        s = F.when(F.col("side") == side, F.col("own")).otherwise(F.col("other"))
        return labels.side_blockers(side, s["state"], F.coalesce(s["coverage"], F.lit("full")), s["reason"], F.coalesce(s["parse_statuses"], F.array().cast("array<string>")))

    kept = F.lit(labels.REMAINS)
    none = F.array().cast("array<string>")
    reasons = F.concat(F.coalesce(blockers("base"), none), F.coalesce(blockers("head"), none), F.when(remains, F.array(kept)).otherwise(none))
    reason = F.array_join(F.transform(reasons, lambda x: F.regexp_replace(x, r"\.$", "")), " ")
    base = F.col("side") == "base"
    removal = F.when(base, "Removal").otherwise("Addition")
    unresolved = labels.fill(labels.UNRESOLVED, F.col("name"), F.col("side"), F.col("path"), removal, reason)
    opening = F.when(base, labels.fill(labels.REMOVED_FROM, F.col("name"), F.col("path"))).otherwise(labels.fill(labels.ADDED_TO, F.col("name"), F.col("path")))
    sources = F.when(~F.col("other.absent"), labels.BOTH_PARSED).when(base, labels.ABSENT_HEAD).otherwise(labels.ABSENT_BASE)
    stated = F.concat(opening, sources, F.lit(labels.ELSEWHERE))
    paths = [F.when(base, F.col("path")).otherwise(F.col("counterpart_path")), F.when(base, F.col("counterpart_path")).otherwise(F.col("path"))]
    both = F.when(F.col("path") != F.col("counterpart_path"), labels.fill(labels.BOTH_PATHS, *paths)).otherwise("")
    return joined.select(*unmatched.columns, "counterpart_path", remains.alias("declaration_remains"), kind.alias("kind"), F.when(confirmed, F.array().cast("array<string>")).otherwise(reasons).alias("blockers"), F.concat(F.when(confirmed, stated).otherwise(unresolved), both).alias("basis"))
