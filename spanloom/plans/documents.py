"""A report as one packet a snapshot: each source stored once, everything else names its lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import packet, projections
from spanloom.plans.compile import Compiled

VERSION = "packet.v1"
METHOD = "static syntax trees, staged unique matching, captured patches; nothing was run"
#: The fields of a packet, in order.
FIELDS = ("schema", "meta", "sources", "file_evidence", "changes", "diffs", "regions", "groups", "dependencies", "analysis", "warnings", "notes")


def _lists(df: DataFrame, name: str, order: list[str], columns: list[Column | str]) -> DataFrame:
    """snapshot_id and array ``name`` of a table's records, in the order of ``order``."""
    rows = df.select("snapshot_id", F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r")).alias("x"))
    return rows.groupBy("snapshot_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias(name))


def _place(side: str) -> Column:
    s = F.col(side)
    return F.when(s.isNotNull(), F.struct(s["fragment_id"].alias("source_id"), s["name"].alias("name"), s["start"].alias("start"), s["end"].alias("end"))).alias(side)


def packets(c: Compiled, fragments: DataFrame, file_evidence: DataFrame, meta: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """snapshot_id and the twelve FIELDS, one row a snapshot of ``meta``; lists without records are empty.

    ``fragments`` are once each; ``meta`` has snapshot_id, base_sha, head_sha and whatever else a packet should tell;
    warnings: snapshot_id, ord, warning.
    """
    sources = packet.sources(fragments, meta).join(fragments.select(F.col("fragment_id").alias("source_id"), "snapshot_id", "idx"), ["snapshot_id", "source_id"])
    members = c.members.groupBy("snapshot_id", "group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "change_id"))), lambda x: x["change_id"]).alias("change_ids"))
    tests = c.test_links.groupBy("snapshot_id", "group_id").agg(F.sort_array(F.collect_set(F.struct("test_id", "symbol_id", "relationship", "status"))).alias("test_links"))
    groups = c.groups.join(members, ["snapshot_id", "group_id"], "left").join(tests, ["snapshot_id", "group_id"], "left")
    cycles = c.groups.where("in_cycle").groupBy("snapshot_id", "component").agg(F.sort_array(F.collect_list("group_id")).alias("members"))
    defined = c.symbols.where("side = 'head' and is_test")
    parts = [
        _lists(sources, "sources", ["idx"], ["source_id", "side", "path", "revision", "start_line", "n_lines", "digest", "text"]),
        _lists(file_evidence, "file_evidence", ["rec_idx"], ["base", "head"]),
        _lists(c.changes, "changes", ["change_id"], ["change_id", "kind", "label", "basis", _place("before"), _place("after")]),
        _lists(c.raw_files, "diffs", ["raw_id"], ["raw_id", "region", F.col("head_path").alias("path"), "origin", "patch", F.col("residual.patch_status").alias("status")]),
        _lists(packet.diff_regions(c.raw_files), "regions", ["raw_id", "hunk", "source_id"], ["region_id", "raw_id", "source_id", "start", "end"]),
        _lists(groups, "groups", ["number"], ["group_id", "title", "path", "theme", "change_ids", "prerequisites", "test_links"]),
        _lists(c.group_edges, "dependencies", ["provider", "consumer", "type"], ["provider", "consumer", "type", "path", "line"]),
        _lists(defined, "tests", ["symbol_id"], ["symbol_id", F.col("fragment_id").alias("source_id"), "start", "end"]),
        _lists(c.symbol_edges, "symbol_edges", ["source", "target", "type"], ["source", "target", "type", "path", "line"]),
        _lists(cycles, "cycles", ["component"], ["members"]),
        _lists(c.unresolved, "unresolved", ["source", "line", "reference"], ["source", "reference", "line", "reason"]),
        _lists(c.notes, "notes", ["idx"], ["note"]),
    ]
    told = [n for n in meta.columns if n != "snapshot_id"]
    base = meta.select("snapshot_id", F.struct(*told).alias("meta"))
    if warnings is not None:
        parts.append(_lists(warnings, "warnings", ["ord"], ["warning"]))
    out = reduce(lambda a, b: a.join(b, "snapshot_id", "left"), parts, base)
    if warnings is None:
        out = out.withColumn("warnings", F.array().cast("array<struct<warning:string>>"))
    lists = [f.name for f in out.schema if f.dataType.typeName() == "array"]
    out = out.withColumns({n: F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)) for n in lists})
    analysis = F.struct("tests", "symbol_edges", "cycles", "unresolved", F.lit(METHOD).alias("method"))
    return out.withColumns({"schema": F.lit(VERSION), "analysis": analysis}).select("snapshot_id", *FIELDS)


def reader_table(c: Compiled) -> DataFrame:
    """What a reader page shows, one row a snapshot: groups in order with narrative, changes, rows of differences and caveats, as JSON of ``render_html``."""
    told = projections.group_narratives(c.groups, c.changes, c.members)
    named = F.coalesce("after.name", "before.name")
    path = F.coalesce("after.path", "before.path")
    places = c.changes.select("snapshot_id", "group_id", path.alias("path")).distinct()
    changes = c.changes.groupBy("snapshot_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("change_id", "label", named.alias("name"), "basis"))).alias("changes"))
    rows = F.flatten(F.transform("residual.hunks", lambda h: h["rows"])).alias("rows")
    differs = c.raw_files.select("snapshot_id", F.col("head_path").alias("path"), rows).where(F.size("rows") > 0).join(places, ["snapshot_id", "path"])
    differs = differs.groupBy("snapshot_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("path", "rows"))).alias("diffs"))
    known = projections.caveats(c.coverage)
    said = F.filter(F.array(*[F.when(F.col(n), F.concat(F.lit(f"{text} "), "side", F.lit(" "), "path")) for n, text in (("partial", "Only part is supplied:"), ("failed", "Not parsed:"), ("text_only", "Text only:"), ("unavailable", "Unavailable:"))]), lambda x: x.isNotNull())
    caveats = known.join(places, ["snapshot_id", "path"]).groupBy("snapshot_id", "group_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(said)))).alias("caveats"))
    groups = c.groups.select("snapshot_id", "group_id", "number", "title", "why_now")
    for part in (told, changes, differs, caveats):
        groups = groups.join(part, ["snapshot_id", "group_id"], "left")
    shown = [n for n in groups.columns if n not in ("snapshot_id", "number")]
    listed = groups.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct("number", *shown))).alias("groups"))
    return listed.select("snapshot_id", F.to_json(F.struct("groups")).alias("report"))
