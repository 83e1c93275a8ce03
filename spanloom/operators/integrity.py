"""Integrity of snapshots, packets, stories and orders: each rule is a query for what breaks it.

Every function gives rows of (snapshot_id, rule, item); no row means that all rules hold. A job over many snapshots can
set the broken ones aside and go on; ``enforce`` makes it fail instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as X

MAX_SNAPSHOT_BYTES = 64_000_000
#: Bounds of written texts, in characters.
MAX_TITLE, MAX_QUESTION, MAX_LABEL, MAX_PASSAGE, MAX_PREAMBLE = 200, 2_000, 160, 6_000, 4_000


def broken(df: DataFrame, rule: str, item: Column, scope: str = "snapshot_id") -> DataFrame:
    return df.select(F.col(scope).cast("string").alias("snapshot_id"), F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(violations: DataFrame) -> DataFrame:
    """Fail the job at the first violation, else give no row."""
    message = F.concat_ws(": ", F.lit("integrity"), "snapshot_id", "rule", "item")
    return violations.where(F.raise_error(message).isNotNull())


def snapshot(meta: DataFrame, fragments: DataFrame, evidence: DataFrame, patches: DataFrame) -> DataFrame:
    """Envelope of a snapshot: byte caps, unique patch paths and evidence sides, safe paths, content unless nothing changed, well-formed revisions."""
    size = fragments.groupBy("snapshot_id").agg(F.sum(F.octet_length("text")).alias("n"))
    patch_size = patches.groupBy("snapshot_id").agg(F.sum(F.octet_length(F.coalesce("patch", F.lit("")))).alias("n"))
    sides = evidence.select("snapshot_id", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base.path").alias("path")), F.struct(F.lit("head").alias("side"), F.col("head.path").alias("path")))).alias("s")).select("snapshot_id", "s.*")
    some = evidence.select("snapshot_id").distinct()
    return union([
        broken(size.where(F.col("n") > MAX_SNAPSHOT_BYTES), "source bytes", F.col("n")),
        broken(patch_size.where(F.col("n") > MAX_SNAPSHOT_BYTES), "patch bytes", F.col("n")),
        broken(patches.groupBy("snapshot_id", "path").count().where("count > 1"), "one patch a path", F.col("path")),
        broken(sides.groupBy("snapshot_id", "side", "path").count().where("count > 1"), "one record a side", F.concat_ws(" ", "side", "path")),
        broken(fragments.where(~X.is_safe_path(F.col("path"))), "safe path", F.col("path")),
        broken(fragments.where(~F.col("side").isin("base", "head") | F.col("side").isNull()), "revision side", F.col("side")),
        broken(fragments.where(F.col("start_line") < 1), "start line", F.col("start_line")),
        broken(evidence.where((F.col("base.state") == "absent") & (F.col("head.state") == "absent")), "not absent on both sides", F.col("head.path")),
        broken(meta.join(some, "snapshot_id", "left_anti").where("coalesce(changed_files, 1) <> 0"), "content unless nothing changed", F.col("changed_files")),
        broken(meta.where(~F.col("base_sha").rlike("^[0-9a-f]{7,64}$") | ~F.col("head_sha").rlike("^[0-9a-f]{7,64}$")), "revisions", F.concat_ws(" ", "base_sha", "head_sha")),
    ])


def coverage(evidence: DataFrame, fragments: DataFrame, patches: DataFrame) -> DataFrame:
    """A whole file is one fragment from line 1 without an excerpt's scope; absent and unavailable sides have none; no fragment is left over; every record has one patch."""
    from spanloom.operators.evidence import evidence_sides

    sides = evidence_sides(evidence)
    held = fragments.groupBy("snapshot_id", "side", "path").agg(F.count("*").alias("n"), F.min("start_line").alias("first"), F.max(F.when(~F.coalesce("scope", F.lit("full")).isin("full", "complete"), F.col("scope"))).alias("excerpt"))
    both = sides.join(held, ["snapshot_id", "side", "path"], "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    item = F.concat_ws(" ", "side", "path")
    whole = (F.col("state") == "supplied") & (F.col("coverage") == "full")
    unmatched = evidence.select("snapshot_id", F.col("head.path").alias("path"), F.lit(1).alias("e")).join(patches.select("snapshot_id", "path", F.lit(1).alias("p")), ["snapshot_id", "path"], "full_outer").where("e is null or p is null")
    return union([
        broken(both.where(whole & (F.col("n") > 1)), "whole file in one fragment", item),
        broken(both.where((F.col("state") == "supplied") & (F.col("n") == 0)), "supplied side has a fragment", item),
        broken(both.where(whole & (F.col("first") != 1)), "whole file from line 1", item),
        broken(both.where(whole & F.col("excerpt").isNotNull()), "whole file is no excerpt", item),
        broken(both.where(F.col("state").isin("absent", "unavailable") & (F.col("n") > 0)), "no fragment without a source", item),
        broken(both.where(F.col("state").isNull()), "fragment without evidence", item),
        broken(unmatched, "one patch a record", F.col("path")),
    ])


def region_rules(fragments: DataFrame, evidence: DataFrame) -> DataFrame:
    """A region has one fragment a side and belongs to one record; both whole sides of a record share theirs."""
    heads = evidence.select("snapshot_id", "rec_idx", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base.path").alias("path"), F.col("base.coverage").alias("coverage")), F.struct(F.lit("head").alias("side"), F.col("head.path").alias("path"), F.col("head.coverage").alias("coverage")))).alias("s"), F.col("head.path").alias("head_path")).select("snapshot_id", "rec_idx", "s.*", "head_path")
    placed = fragments.join(heads, ["snapshot_id", "side", "path"]).withColumn("region", F.coalesce("region", "head_path"))
    return union([
        broken(placed.groupBy("snapshot_id", "region", "side").count().where("count > 1"), "one fragment a region and side", F.concat_ws(" ", "side", "region")),
        broken(placed.groupBy("snapshot_id", "region").agg(F.countDistinct("rec_idx").alias("n")).where("n > 1"), "region of one record", F.col("region")),
        broken(placed.where("coverage = 'full'").groupBy("snapshot_id", "rec_idx").agg(F.countDistinct("region").alias("n")).where("n > 1"), "whole sides share a region", F.col("rec_idx")),
    ])


def overlapping_ranges(fragments: DataFrame) -> DataFrame:
    """Excerpts of one file side whose lines overlap; empty texts have none. One running maximum, no self join."""
    spans = fragments.where(F.col("text") != "").select("snapshot_id", "side", "path", "fragment_id", F.col("start_line").alias("start"), (F.col("start_line") + X.line_count(F.col("text")) - 1).alias("end"))
    before = Window.partitionBy("snapshot_id", "side", "path").orderBy("start", "end", "fragment_id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("end").over(before)).where("reached >= start").select("snapshot_id", "side", "path", "fragment_id", "start", "end", "reached")


def order_rules(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """A reading order: numbers 1 to n, prerequisites first, members of a cycle side by side."""
    place = groups.select("snapshot_id", F.col("group_id"), "number", "component")
    numbers = place.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("lo"), F.max("number").alias("hi")).where("d <> n or lo <> 1 or hi <> n")
    a = place.select("snapshot_id", F.col("group_id").alias("consumer"), F.col("number").alias("c"), F.col("component").alias("c_part"))
    b = place.select("snapshot_id", F.col("group_id").alias("provider"), F.col("number").alias("p"), F.col("component").alias("p_part"))
    late = edges.join(a, ["snapshot_id", "consumer"]).join(b, ["snapshot_id", "provider"]).where("c_part <> p_part and p >= c")
    apart = place.groupBy("snapshot_id", "component").agg(F.count("*").alias("n"), (F.max("number") - F.min("number") + 1).alias("width")).where("width <> n")
    return union([
        broken(numbers, "numbers are a permutation", F.col("n")),
        broken(late, "prerequisite first", F.concat_ws(" before ", "provider", "consumer")),
        broken(apart, "cycle is contiguous", F.col("component")),
    ])


def exact_partition(parts: DataFrame, whole: DataFrame, scope: str, item: str) -> DataFrame:
    """Items of ``whole`` that ``parts`` misses, has twice, or adds."""
    counted = parts.groupBy(scope, item).agg(F.count("*").alias("n"))
    joined = counted.join(whole.select(scope, item).distinct().withColumn("w", F.lit(1)), [scope, item], "full_outer")
    return joined.where("n is null or n > 1 or w is null").select(scope, item, F.when(F.col("n").isNull(), "missing").when(F.col("w").isNull(), "added").otherwise("repeated").alias("fault"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side that has them."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def citation_rules(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations name a source of their revision and lie inside it. sources: snapshot_id, source_id, revision, start_line, n_lines."""
    joined = citations.alias("c").join(sources.alias("s"), ["snapshot_id", "source_id"], "left")
    item = F.concat_ws(" ", "source_id", F.col("c.start"), F.col("c.end"))
    inside = (F.col("c.start") >= F.col("s.start_line")) & (F.col("c.end") < F.col("s.start_line") + F.col("s.n_lines")) & (F.col("c.start") <= F.col("c.end"))
    return union([
        broken(joined.where(F.col("s.revision").isNull()), "cited source is there", item),
        broken(joined.where(F.col("s.revision") != F.col("c.revision")), "revision of a citation", item),
        broken(joined.where(F.col("s.revision").isNotNull() & ~inside), "citation inside its source", item),
    ])


def story_rules(passages: DataFrame, citations: DataFrame, changes: DataFrame, regions: DataFrame) -> DataFrame:
    """Passages: unique ids, bounded texts, all changes and regions told, every told region met by a citation of its source."""
    told_changes = passages.select("snapshot_id", "passage_id", F.explode("change_ids").alias("change_id"))
    told_regions = passages.select("snapshot_id", "passage_id", F.explode("region_ids").alias("region_id"))
    spans = regions.select("snapshot_id", "region_id", "source_id", F.col("start").alias("r0"), F.col("end").alias("r1"))
    met = told_regions.join(spans, ["snapshot_id", "region_id"]).join(citations, ["snapshot_id", "passage_id", "source_id"]).where("start <= r1 and r0 <= end")
    return union([
        broken(passages.groupBy("snapshot_id", "passage_id").count().where("count > 1"), "unique passage", F.col("passage_id")),
        broken(passages.where((F.length("title") > MAX_TITLE) | (F.length("text") > MAX_PASSAGE)), "bounded passage", F.col("passage_id")),
        broken(changes.join(told_changes, ["snapshot_id", "change_id"], "left_anti"), "change is told", F.col("change_id")),
        broken(told_changes.join(changes, ["snapshot_id", "change_id"], "left_anti"), "told change is there", F.col("change_id")),
        broken(regions.join(told_regions, ["snapshot_id", "region_id"], "left_anti"), "region is told", F.col("region_id")),
        broken(told_regions.join(met.select("snapshot_id", "passage_id", "region_id").distinct(), ["snapshot_id", "passage_id", "region_id"], "left_anti"), "told region is cited", F.col("region_id")),
    ])


def usage_rules(usage: DataFrame) -> DataFrame:
    """Token use of runs: nothing negative, no more cached than given, no more unreported calls than calls."""
    return union([
        broken(usage.where("input_tokens < 0 or output_tokens < 0 or cached_tokens < 0 or calls < 0"), "not negative", F.col("calls")),
        broken(usage.where("cached_tokens > input_tokens"), "cached within input", F.col("cached_tokens")),
        broken(usage.where("unreported > calls"), "unreported within calls", F.col("unreported")),
    ])


def field_rules(df: DataFrame, id_columns: list[str], number_columns: list[str], tags: dict[str, list[str]]) -> DataFrame:
    """Identifiers are 16 hex digits, numbers are not negative, tags are of their lists; nulls are let pass."""
    parts = [broken(df.where(~F.col(c).rlike("^[0-9a-f]{16}$")), f"identifier {c}", F.col(c)) for c in id_columns]
    parts += [broken(df.where(F.col(c) < 0), f"number {c}", F.col(c)) for c in number_columns]
    parts += [broken(df.where(~F.col(c).isin(v)), f"tag {c}", F.col(c)) for c, v in tags.items()]
    return union(parts)


def packet_rules(sources: DataFrame, regions: DataFrame, raw: DataFrame) -> DataFrame:
    """A packet: digests are of their texts, revisions well formed, regions exactly those of texts that differ, inside their sources."""
    changed = raw.where("residual.patch_status = 'captured'").select("snapshot_id", "raw_id").distinct()
    told = regions.select("snapshot_id", "raw_id").distinct()
    box = regions.join(sources.select("snapshot_id", "source_id", "start_line", "n_lines"), ["snapshot_id", "source_id"], "left")
    outside = F.col("start_line").isNull() | (F.col("start") < F.col("start_line")) | (F.col("end") >= F.col("start_line") + F.col("n_lines"))
    return union([
        broken(sources.where(X.digest(F.col("text")) != F.col("digest")), "digest of a source", F.col("source_id")),
        broken(sources.where(~F.col("revision").rlike("^[0-9a-f]{7,64}$")), "revision of a source", F.col("source_id")),
        broken(changed.join(told, ["snapshot_id", "raw_id"], "left_anti"), "region of a difference", F.col("raw_id")),
        broken(told.join(changed, ["snapshot_id", "raw_id"], "left_anti"), "difference of a region", F.col("raw_id")),
        broken(box.where(outside), "region inside its source", F.col("region_id")),
    ])


def report_rules(groups: DataFrame, edges: DataFrame, members: DataFrame, changes: DataFrame, stats: DataFrame) -> DataFrame:
    """A report: order rules, well-formed ids, every change in one group, stats that add up."""
    parted = exact_partition(members, changes, "snapshot_id", "change_id")
    counts = changes.groupBy("snapshot_id").agg(F.count("*").alias("n"))
    off = stats.join(counts, "snapshot_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("units"))
    return union([
        order_rules(groups, edges), field_rules(groups, ["group_id"], ["number"], {}), field_rules(changes, ["change_id"], [], {}),
        broken(parted, "change in one group", F.concat_ws(" ", "change_id", "fault")), broken(off, "units of stats", F.col("units")),
    ])


def reference_rules(checks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Excerpts that an author checked are exact parts of the description. checks: snapshot_id, excerpt; descriptions: snapshot_id, description."""
    return broken(checks.join(descriptions, "snapshot_id", "left").where(F.instr(F.coalesce("description", F.lit("")), F.col("excerpt")) == 0), "checked excerpt", F.col("excerpt"))


def part_rules(passages: DataFrame, most_bytes: int = 24_576) -> DataFrame:
    """A writer's part: titles, texts and prose within bounds, and its whole projection within ``most_bytes``."""
    body = F.octet_length(F.to_json(F.struct(*passages.columns)))
    return union([
        broken(passages.where(F.length("title") > MAX_TITLE), "title", F.col("passage_id")),
        broken(passages.where(X.prose_length(F.col("text")) > MAX_PREAMBLE), "prose", F.col("passage_id")),
        broken(passages.groupBy("snapshot_id").agg(F.sum(body).alias("n")).where(F.col("n") > most_bytes), "size of the part", F.col("n")),
    ])


def passage_rules(passages: DataFrame, members: DataFrame, changes: DataFrame) -> DataFrame:
    """Passages of groups: told texts, changes of their own group once each, a known view, and a focus inside the one definition it is of.

    passages: snapshot_id, group_id, passage_id, text, change_ids, view, label, focus (struct of start and end, or null).
    """
    own = members.groupBy("snapshot_id", "group_id").agg(F.collect_set("change_id").alias("own"))
    side = F.coalesce("after", "before")
    spans = changes.select("snapshot_id", F.col("change_id").alias("only"), side["start"].alias("first"), side["end"].alias("last"))
    ids = F.coalesce("change_ids", F.array().cast("array<string>"))
    held = passages.withColumn("only", F.get(ids, F.lit(0))).join(own, ["snapshot_id", "group_id"], "left").join(spans, ["snapshot_id", "only"], "left")
    focused = held.where("focus is not null")
    inside = (F.col("first") <= F.col("focus.start")) & (F.col("focus.start") <= F.col("focus.end")) & (F.col("focus.end") <= F.col("last"))
    item = F.col("passage_id")
    return union([
        broken(held.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0), "passage has a text", item),
        broken(held.where(F.length("text") > MAX_PASSAGE), "bounded passage", item),
        broken(held.where(F.size(ids) == 0), "passage has a change", item),
        broken(held.where(F.size(F.array_except(ids, F.coalesce("own", F.array().cast("array<string>")))) > 0), "change of its group", item),
        broken(held.where(F.size(F.array_distinct(ids)) < F.size(ids)), "change once", item),
        broken(held.where(~F.coalesce("view", F.lit("definition")).isin("definition", "diff")), "view", item),
        broken(held.where(F.length("label") > MAX_LABEL), "label", item),
        broken(focused.where((F.size(ids) != 1) | (F.coalesce("view", F.lit("definition")) == "diff")), "focus of one definition", item),
        broken(focused.where(~F.coalesce(inside, F.lit(False))), "focus inside its definition", item),
    ])


def editorial_rules(references: DataFrame, passages: DataFrame, routes: DataFrame) -> DataFrame:
    """What an editor refers to: told passages only, each once, at least one; routes of different kinds, the mechanism among them.

    references: snapshot_id, field, passage_ids; routes: snapshot_id, kind.
    """
    flat = references.select("snapshot_id", "field", F.explode("passage_ids").alias("passage_id"))
    kinds = routes.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("d"), F.count_if(F.col("kind") == "mechanism").alias("m"))
    return union([
        broken(references.where(F.size("passage_ids") < 1), "reference names a passage", F.col("field")),
        broken(references.where(F.size(F.array_distinct("passage_ids")) < F.size("passage_ids")), "reference names a passage once", F.col("field")),
        broken(flat.join(passages.select("snapshot_id", "passage_id").distinct(), ["snapshot_id", "passage_id"], "left_anti"), "referred passage is there", F.concat_ws(" ", "field", "passage_id")),
        broken(kinds.where("d < n"), "routes of different kinds", F.col("n")),
        broken(kinds.where("m = 0"), "mechanism route", F.col("n")),
    ])


#: Calls of a run, and bytes of what it adds to a packet.
MOST_CALLS, MOST_ADDED_BYTES = 12, 1 << 20
REPORT_KEYS = ("generation", "packet", "schema", "story")


def walkthrough_rules(reports: DataFrame, version: str) -> DataFrame:
    """Reports with a written story: exact keys, version, digest and revisions of their packet, a named writer, calls and bytes within limits.

    reports: snapshot_id, body (the report's JSON), packet_digest, base_sha and head_sha (of the packet that it must be of).
    """
    generation = F.from_json(F.get_json_object("body", "$.generation"), "evidence_digest string, base_sha string, head_sha string, provider string, model string, destination string, usage struct<calls:bigint,unreported_calls:bigint,input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>")
    g = reports.withColumn("g", generation)
    added = F.octet_length(F.coalesce(F.get_json_object("body", "$.story"), F.lit(""))) + F.octet_length(F.coalesce(F.get_json_object("body", "$.generation"), F.lit("")))
    named = reduce(lambda a, b: a & b, (F.coalesce(F.length(F.trim(F.col(f"g.{c}"))), F.lit(0)) > 0 for c in ("provider", "model", "destination")))
    usage = F.col("g.usage")
    counts = [F.coalesce(usage[c], F.lit(-1)) for c in ("calls", "unreported_calls", "input_tokens", "cached_input_tokens", "output_tokens")]
    sound = (F.least(*counts) >= 0) & (usage["cached_input_tokens"] <= usage["input_tokens"]) & (usage["unreported_calls"] <= usage["calls"])
    item = F.col("snapshot_id")
    return union([
        broken(g.where(~F.sort_array(F.json_object_keys("body")).eqNullSafe(F.array(*map(F.lit, REPORT_KEYS)))), "keys of a report", item),
        broken(g.where(~F.get_json_object("body", "$.schema").eqNullSafe(F.lit(version))), "version of a report", item),
        broken(g.where(~F.col("g.evidence_digest").eqNullSafe(F.col("packet_digest"))), "digest of the packet", item),
        broken(g.where(~(F.col("g.base_sha").eqNullSafe(F.col("base_sha")) & F.col("g.head_sha").eqNullSafe(F.col("head_sha")))), "revisions of the packet", item),
        broken(g.where(~named), "writer is named", item), broken(g.where(~F.coalesce(sound, F.lit(False))), "usage adds up", item),
        broken(g.where(usage["calls"] > MOST_CALLS), "calls of a run", usage["calls"]), broken(g.where(added > MOST_ADDED_BYTES), "bytes of a story", added),
    ])


def link_rules(groups: DataFrame, edges: DataFrame, links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges and test links of a report lead from and to groups and symbols that are there."""
    there, known = groups.select("snapshot_id", "group_id"), symbols.select("snapshot_id", "symbol_id").distinct()
    ends = edges.select("snapshot_id", F.explode(F.array("provider", "consumer")).alias("group_id")).unionByName(links.select("snapshot_id", "group_id"))
    named = links.select("snapshot_id", F.explode(F.array("test_id", "symbol_id")).alias("symbol_id"))
    return union([
        broken(ends.join(there, ["snapshot_id", "group_id"], "left_anti"), "linked group is there", F.col("group_id")),
        broken(named.join(known, ["snapshot_id", "symbol_id"], "left_anti"), "linked symbol is there", F.col("symbol_id")),
    ])
