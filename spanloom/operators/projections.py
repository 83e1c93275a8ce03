"""Projections of compiled tables for packets, editors and readers, and the small aggregates beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import labels
from spanloom.functions import text as X


def public_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols as they may leave the engine: without fingerprints, the fragment under its public name."""
    return symbols.drop("fingerprint", "rename_fingerprint").withColumnRenamed("fragment_id", "fragment_key")


def source_evidence(coverage: DataFrame, fragments: DataFrame) -> DataFrame:
    """One public record a file side: state, coverage, reason, parse statuses and digests of its fragments in order."""
    digests = fragments.groupBy("snapshot_id", "side", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", X.digest(F.col("text")).alias("d")))), lambda x: x["d"]).alias("digests"))
    return coverage.join(digests, ["snapshot_id", "side", "path"], "left").select("snapshot_id", "rec_idx", "side", "path", "state", "coverage", "reason", "counterpart_path", "parse_statuses", F.coalesce("digests", F.array().cast("array<string>")).alias("digests"))


def bare_hunks(hunks: Column) -> Column:
    """Hunks whose rows keep tag and numbers but no text, since the sources have it."""
    return F.transform(hunks, lambda h: F.struct(h["old_start"].alias("old_start"), h["new_start"].alias("new_start"), F.transform(h["rows"], lambda r: F.struct(r["tag"].alias("tag"), r["old"].alias("old"), r["new"].alias("new"))).alias("rows")))


def rows_of_change(raw: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the file differences that lie in a change's spans: snapshot_id, change_id, raw_id, hunk, row, tag, old, new, text."""
    flat = raw.select("snapshot_id", "raw_id", F.col("before.fragment_id").alias("b"), F.col("after.fragment_id").alias("a"), F.posexplode("residual.hunks").alias("hunk", "h")).select("snapshot_id", "raw_id", "a", "b", "hunk", F.posexplode("h.rows").alias("row", "r"))
    spans = changes.select("snapshot_id", "change_id", F.col("before.fragment_id").alias("cb"), F.col("before.start").alias("b0"), F.col("before.end").alias("b1"), F.col("after.fragment_id").alias("ca"), F.col("after.start").alias("a0"), F.col("after.end").alias("a1"))
    sides = flat.join(spans.where("cb is not null").withColumn("b", F.col("cb")), ["snapshot_id", "b"]).where("r.old between b0 and b1").select("snapshot_id", "change_id", "raw_id", "hunk", "row", "r")
    heads = flat.join(spans.where("ca is not null").withColumn("a", F.col("ca")), ["snapshot_id", "a"]).where("r.new between a0 and a1").select("snapshot_id", "change_id", "raw_id", "hunk", "row", "r")
    return sides.union(heads).select("snapshot_id", "change_id", "raw_id", "hunk", "row", "r.*").distinct()


def hunk_headers(rows: DataFrame) -> DataFrame:
    """Headers of hunks recomputed from the rows that were kept."""
    keys = [c for c in ("snapshot_id", "change_id", "raw_id", "hunk") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.min("old").alias("old_start"), F.count("old").alias("old_count"), F.min("new").alias("new_start"), F.count("new").alias("new_count"))


def symbol_sources(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """The source of each symbol: its own fragment, or the one buffer of its path and side that contains it."""
    own = symbols.join(sources.select("snapshot_id", F.col("source_id").alias("fragment_id"), F.col("source_id").alias("own")), ["snapshot_id", "fragment_id"], "left")
    boxes = sources.select("snapshot_id", "side", "path", "source_id", F.col("start_line").alias("s0"), (F.col("start_line") + F.col("n_lines") - 1).alias("s1"))
    found = own.where("own is null").join(boxes, ["snapshot_id", "side", "path"]).where("s0 <= start and end <= s1").groupBy("snapshot_id", "symbol_id").agg(F.count("*").alias("n"), F.min("source_id").alias("sole")).where("n = 1").drop("n")
    return own.join(found, ["snapshot_id", "symbol_id"], "left").withColumn("source_id", F.coalesce("own", "sole")).drop("own", "sole")


def region_sources(regions: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of regions by side; a region with several buffers of one side is marked."""
    joined = regions.join(sources.select("snapshot_id", "source_id", "side"), ["snapshot_id", "source_id"])
    return joined.groupBy("snapshot_id", "region_id", "side").agg(F.min("source_id").alias("source_id"), (F.countDistinct("source_id") > 1).alias("ambiguous"))


def side_evidence(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """Coverage of both sides of a change: its own path first, else the path of its other side."""
    c = coverage.select("snapshot_id", "side", "path", F.struct("state", "coverage", "reason", "parse_statuses").alias("e")).dropDuplicates(["snapshot_id", "side", "path"])
    out = changes.select("snapshot_id", "change_id", F.col("before.path").alias("bp"), F.col("after.path").alias("ap"))
    for side, own, other in (("base", "bp", "ap"), ("head", "ap", "bp")):
        for n, key in (("own", own), ("other", other)):
            out = out.join(c.where(F.col("side") == side).select("snapshot_id", F.col("path").alias(key), F.col("e").alias(f"{side}_{n}")), ["snapshot_id", key], "left")
    return out.select("snapshot_id", "change_id", F.coalesce("base_own", "base_other").alias("base"), F.coalesce("head_own", "head_other").alias("head"))


def caveats(coverage: DataFrame) -> DataFrame:
    """What a reader must know of each file side: partial, failed, text only, unavailable and the distinct reasons."""
    return coverage.groupBy("snapshot_id", "side", "path").agg(
        F.bool_or(F.coalesce(F.col("coverage") == "partial", F.lit(False))).alias("partial"), F.bool_or(F.array_contains("parse_statuses", "failed")).alias("failed"),
        F.bool_or(F.array_contains("parse_statuses", "text_only")).alias("text_only"), F.bool_or(F.col("state") == "unavailable").alias("unavailable"), F.sort_array(F.collect_set("reason")).alias("reasons"),
    )


def code_terms(symbols: DataFrame) -> DataFrame:
    """One pattern a snapshot of all names and paths, longest first, with their special characters escaped."""
    terms = symbols.select("snapshot_id", F.explode(F.array("name", "path")).alias("term")).where("term <> ''").distinct()
    escaped = F.regexp_replace("term", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return terms.groupBy("snapshot_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("n"), escaped.alias("t")))), lambda x: x["t"]), "|").alias("pattern"))


def item_sizes(df: DataFrame, key: str) -> DataFrame:
    """Canonical JSON bytes of each record of a table, by key."""
    from spanloom.plans.writing import canonical

    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select("snapshot_id", F.col(key).alias("item_id"), F.octet_length(canonical(body)).alias("n_bytes"))


def named(names: Column, most: int = 4) -> Column:
    """The first names of a list, with a note that there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, " and related symbols").otherwise(""))


def group_names(changes: DataFrame, members: DataFrame) -> DataFrame:
    """Names of each group's changes in order, at most four of them."""
    s = F.coalesce("after", "before")
    held = changes.select("snapshot_id", "change_id", s["name"].alias("name"), s["start"].alias("start")).join(members.select("snapshot_id", "change_id", "group_id"), ["snapshot_id", "change_id"])
    names = held.groupBy("snapshot_id", "group_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("start", "change_id", "name"))), lambda x: x["name"])).alias("names"))
    return names.withColumn("summary", named(F.col("names")))


def narrative(kinds: Column, theme: Column, path: Column, names: Column, n_changes: Column, befores: Column, afters: Column) -> Column:
    """What a reader of a group is told: intent, before, after, takeaway, invariants, questions and provenance.

    ``kinds`` are the group's kinds, ``names`` those of its changes in order, ``befores`` and ``afters`` their distinct paths.
    """
    some = lambda *of: F.arrays_overlap(kinds, F.array(*map(F.lit, of)))
    only = lambda *of: F.size(F.array_except(kinds, F.array(*map(F.lit, of)))) == 0
    by_theme = lambda tests, wiring, else_: F.when(theme == "tests", tests).when(theme == "wiring", wiring).otherwise(else_)
    renamed = some("moved_renamed", "renamed")

    def points(same: str, usual: str, alike: str) -> Column:
        first = F.when(only("moved", "source_only"), same).otherwise(usual)
        return F.when(renamed, F.array(first, F.lit(alike))).otherwise(F.array(first))

    moved = F.when(some("moved", "moved_renamed", "moved_modified"), labels.fill(labels.INTENT_MOVE, theme)).otherwise(labels.fill(labels.INTENT, theme, F.element_at(F.split(path, "/"), -1)))
    more = F.when(n_changes > 4, labels.RELATED).otherwise("")
    return F.struct(
        by_theme(F.lit(labels.INTENT_TESTS), F.lit(labels.INTENT_WIRING), moved).alias("intent"),
        F.array_join(F.sort_array(befores), "; ").alias("before"), F.array_join(F.sort_array(afters), "; ").alias("after"),
        labels.fill(labels.TAKEAWAY, n_changes, F.array_join(F.slice(names, 1, 4), ", "), more).alias("takeaway"),
        by_theme(F.array(F.lit(labels.INVARIANT_TESTS)), F.array(F.lit(labels.INVARIANT_WIRING)), points(labels.INVARIANT_SAME, labels.INVARIANT, labels.INVARIANT_RENAMED)).alias("invariants"),
        by_theme(F.array(F.lit(labels.QUESTION_TESTS)), F.array(F.lit(labels.QUESTION_WIRING)), points(labels.QUESTION_SAME, labels.QUESTION, labels.QUESTION_RENAMED)).alias("questions"),
        F.lit(labels.PROVENANCE).alias("provenance"),
    )


def group_narratives(groups: DataFrame, changes: DataFrame, members: DataFrame) -> DataFrame:
    """snapshot_id, group_id and the narrative of every group; ``members`` has the place of each change in its group as ``number``."""
    place = members.select("snapshot_id", "group_id", "change_id", "number")
    held = changes.select("snapshot_id", "change_id", "kind", F.coalesce("after.name", "before.name", F.lit("file context")).alias("name"), F.coalesce("before.path", F.lit(labels.NO_BASE)).alias("b"), F.coalesce("after.path", F.lit(labels.NO_HEAD)).alias("a"))
    told = held.join(place, ["snapshot_id", "change_id"]).groupBy("snapshot_id", "group_id").agg(
        F.collect_set("kind").alias("kinds"), F.transform(F.sort_array(F.collect_list(F.struct("number", "name"))), lambda x: x["name"]).alias("names"), F.count("*").alias("n"), F.collect_set("b").alias("befores"), F.collect_set("a").alias("afters")
    )
    joined = groups.select("snapshot_id", "group_id", "theme", "path").join(told, ["snapshot_id", "group_id"])
    return joined.select("snapshot_id", "group_id", narrative(F.col("kinds"), F.col("theme"), F.col("path"), F.col("names"), F.col("n"), F.col("befores"), F.col("afters")).alias("n")).select("snapshot_id", "group_id", "n.*")


def editor_projection(passages: DataFrame, tests: DataFrame) -> DataFrame:
    """Passages for an editor, without sources: texts, how many citations each has, and the tests whose source it cites."""
    flat = passages.select("snapshot_id", "passage_id", F.explode("citations").alias("c")).select("snapshot_id", "passage_id", F.col("c.source_id").alias("source_id"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))
    near = flat.join(tests.select("snapshot_id", "source_id", "test_id", F.col("start").alias("t0"), F.col("end").alias("t1")), ["snapshot_id", "source_id"]).where("start <= t1 and t0 <= end")
    ids = near.groupBy("snapshot_id", "passage_id").agg(F.sort_array(F.collect_set("test_id")).alias("related_tests"))
    return passages.select("snapshot_id", "passage_id", "title", "text", F.size("citations").alias("n_citations")).join(ids, ["snapshot_id", "passage_id"], "left").withColumn("related_tests", F.coalesce("related_tests", F.array().cast("array<string>")))


def manual_packet(groups: DataFrame, changes: DataFrame, links: DataFrame) -> DataFrame:
    """What a writer by hand needs of each snapshot: groups in order with their changes, and test links."""
    of = changes.select("snapshot_id", "group_id", F.struct("change_id", "kind", "label", "basis").alias("c")).groupBy("snapshot_id", "group_id").agg(F.sort_array(F.collect_list("c")).alias("changes"))
    told = groups.join(of, ["snapshot_id", "group_id"], "left").groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct("number", "group_id", "title", "why_now", "changes"))).alias("groups"))
    tests = links.groupBy("snapshot_id").agg(F.sort_array(F.collect_set(F.struct("test_id", "symbol_id", "relationship", "status"))).alias("tests"))
    return told.join(tests, "snapshot_id", "left")


def order_changes(members: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Changes of each group in prerequisite-first order, ties by place: snapshot_id, group_id, change_id, number."""
    from spanloom.operators import graph

    a = owner.select("snapshot_id", F.col("symbol_id").alias("source"), F.col("change_id").alias("consumer"), F.col("group_id").alias("g1"))
    b = owner.select("snapshot_id", F.col("symbol_id").alias("target"), F.col("change_id").alias("provider"), F.col("group_id").alias("g2"))
    inner = edges.join(a, ["snapshot_id", "source"]).join(b, ["snapshot_id", "target"]).where("g1 = g2 and consumer <> provider")
    scope = F.concat_ws("/", "snapshot_id", "group_id")
    nodes = members.select(scope.alias("scope"), F.col("change_id").alias("node"), F.array(F.lpad(F.col("start").cast("string"), 9, "0")).alias("key"))
    needs = inner.select(F.concat_ws("/", "snapshot_id", "g1").alias("scope"), F.col("consumer").alias("node"), F.col("provider").alias("needs")).distinct()
    placed = graph.order_nodes(nodes, needs, "scope")
    return members.withColumn("scope", scope).join(placed.select("scope", F.col("node").alias("change_id"), "number"), ["scope", "change_id"]).select("snapshot_id", "group_id", "change_id", "number")

