"""Compiling pinned comparisons into changes, groups, edges and a reading order, all snapshots at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as X
from spanloom.operators import diff, evidence, extract, graph, match, projections, tables
from spanloom.session import materialize


@dataclass(frozen=True)
class Compiled:
    """Tables of a report, keyed by snapshot_id."""

    symbols: DataFrame
    imports: DataFrame
    coverage: DataFrame
    pairs: DataFrame
    changes: DataFrame
    raw_files: DataFrame
    groups: DataFrame
    members: DataFrame
    group_edges: DataFrame
    symbol_edges: DataFrame
    unresolved: DataFrame
    test_links: DataFrame
    stats: DataFrame
    notes: DataFrame


def symbol_changes(symbols: DataFrame, pairs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Changes of matched and of unmatched declarations; a pair of one path and equal source is none."""
    record = F.struct("symbol_id", "path", "name", "node_type", "start", "end", "source", "fingerprint", "rename_fingerprint", "doc", "signature", "is_test", "fragment_id")
    once = tables.least_row(symbols, ["snapshot_id", "side", "symbol_id"], ["fragment_id", "ord"])
    old = once.where("side = 'base'").select("snapshot_id", F.col("symbol_id").alias("before_id"), record.alias("before"))
    new = once.where("side = 'head'").select("snapshot_id", F.col("symbol_id").alias("after_id"), record.alias("after"))
    named = pairs.withColumnsRenamed({"before": "before_id", "after": "after_id"})
    joined = named.join(old, ["snapshot_id", "before_id"]).join(new, ["snapshot_id", "after_id"])
    same = (F.col("before.path") == F.col("after.path")) & (F.col("before.source") == F.col("after.source"))
    matched = joined.where(~same).withColumn("kind", labels.change_kind(F.col("before"), F.col("after")))
    taken = pairs.select("snapshot_id", F.col("before").alias("symbol_id")).withColumn("side", F.lit("base")).union(pairs.select("snapshot_id", F.col("after").alias("symbol_id")).withColumn("side", F.lit("head")))
    alone = once.join(taken, ["snapshot_id", "symbol_id", "side"], "left_anti")
    slim = alone.select("snapshot_id", "side", "symbol_id", "path", "name", "node_type", record.alias("s"))
    judged = evidence.definition_evidence(slim, once.select("snapshot_id", "side", "path", "name", "node_type"), coverage)
    missing = F.lit(None).cast(judged.schema["s"].dataType)
    single = judged.select(
        "snapshot_id", F.when(F.col("side") == "base", F.col("s")).otherwise(missing).alias("before"), F.when(F.col("side") == "head", F.col("s")).otherwise(missing).alias("after"), "kind", "basis"
    )
    both = matched.select("snapshot_id", "before", "after", "kind", "basis").unionByName(single)
    paired = F.col("before").isNotNull() & F.col("after").isNotNull()
    return both.withColumns({
        "change_id": X.stable_id(F.coalesce("before.symbol_id", F.lit("")), F.coalesce("after.symbol_id", F.lit("")), F.col("kind")),
        "label": labels.label(F.col("kind")),
        "signature_changed": F.when(paired, ~F.col("before.signature").eqNullSafe(F.col("after.signature"))),
        "docstring_changed": F.when(paired, ~F.col("before.doc").eqNullSafe(F.col("after.doc"))),
        "raw_id": F.lit(None).cast("string"),
    })


def covered_ranges(changes: DataFrame) -> DataFrame:
    """snapshot_id, fragment_id, ranges: the lines of each fragment that symbol changes account for."""
    sides = changes.select("snapshot_id", F.explode(F.array("before", "after")).alias("s")).where("s is not null")
    return sides.groupBy("snapshot_id", F.col("s.fragment_id").alias("fragment_id")).agg(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"))).alias("ranges"))


def raw_changes(fragments: DataFrame, file_evidence: DataFrame, patches: DataFrame, coverage: DataFrame, changes: DataFrame) -> DataFrame:
    """Regions whose texts differ, with their patch and what declarations leave of it (struct ``residual``)."""
    pairs = tables.regions(fragments, file_evidence).where(~F.col("before.text").eqNullSafe(F.col("after.text")))
    pairs = pairs.where(~(F.coalesce("before.text", F.lit("")) == F.coalesce("after.text", F.lit(""))))
    head_path, base_path = F.coalesce("after.path", "head_path"), F.coalesce("before.path", "base_path")
    state = coverage.select("snapshot_id", "side", "path", "absent", "full_source").dropDuplicates(["snapshot_id", "side", "path"])
    head = state.where("side = 'head'").select("snapshot_id", F.col("path").alias("head_path"), F.col("absent").alias("h_absent"), F.col("full_source").alias("h_full"))
    base = state.where("side = 'base'").select("snapshot_id", F.col("path").alias("base_path"), F.col("absent").alias("b_absent"), F.col("full_source").alias("b_full"))
    texts = patches.select("snapshot_id", F.col("path").alias("head_path"), "origin", "patch")
    texts = tables.least_row(texts, ["snapshot_id", "head_path"], [F.col("patch").asc_nulls_last(), "origin"])
    cover = covered_ranges(changes)
    joined = (
        pairs.withColumns({"head_path": head_path, "base_path": base_path})
        .join(head, ["snapshot_id", "head_path"], "left").join(base, ["snapshot_id", "base_path"], "left").join(texts, ["snapshot_id", "head_path"], "left")
        .withColumns({"b_id": F.col("before.fragment_id"), "a_id": F.col("after.fragment_id")})
        .join(cover.select("snapshot_id", F.col("fragment_id").alias("b_id"), F.col("ranges").alias("covered_old")), ["snapshot_id", "b_id"], "left")
        .join(cover.select("snapshot_id", F.col("fragment_id").alias("a_id"), F.col("ranges").alias("covered_new")), ["snapshot_id", "a_id"], "left")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    complete = (F.col("b_absent") | (F.col("b_full") & F.col("before").isNotNull())) & (F.col("h_absent") | (F.col("h_full") & F.col("after").isNotNull()))
    ready = joined.withColumns({
        "before_text": F.col("before.text"), "after_text": F.col("after.text"), "first_old": F.coalesce("before.start_line", F.lit(1)), "first_new": F.coalesce("after.start_line", F.lit(1)),
        "complete": F.coalesce(complete, F.lit(False)), "covered_old": F.coalesce("covered_old", none), "covered_new": F.coalesce("covered_new", none),
    })
    kept = ["snapshot_id", "region", "head_path", "base_path", "before", "after", "origin", "patch", "residual"]
    return diff.with_residual(ready).select(*kept).withColumn("raw_id", X.stable_id(F.lit("raw"), F.col("region")))


def residual_changes(raw: DataFrame, like: DataFrame) -> DataFrame:
    """The leftover changes of raw regions in the shape of symbol changes."""
    flat = raw.select("snapshot_id", "raw_id", "before", "after", F.explode("residual.changes").alias("c"))

    def side(name: str, start: str, end: str):
        s, a, b = F.col(name), F.col(f"c.{start}"), F.col(f"c.{end}")
        part = F.slice(X.lines(s["text"]), a - F.coalesce(s["start_line"], F.lit(1)) + 1, b - a + 1)
        exact = F.slice(X.lines_with_ends(s["text"]), a - F.coalesce(s["start_line"], F.lit(1)) + 1, b - a + 1)
        id_ = F.when(F.col("c.raw_only"), X.stable_id(s["fragment_id"], F.lit("raw-text"), a, b)).otherwise(X.stable_id(s["fragment_id"], F.lit("context")))
        record = F.struct(
            id_.alias("symbol_id"), s["path"].alias("path"), F.when(F.col("c.kind") == "wiring", "module imports / context").otherwise("file context").alias("name"), F.lit(None).cast("string").alias("node_type"), a.alias("start"), b.alias("end"),
            F.when(F.col("c.raw_only"), F.array_join(exact, "")).otherwise(F.array_join(part, "\n")).alias("source"), *[F.lit(None).cast("string").alias(n) for n in ("fingerprint", "rename_fingerprint", "doc", "signature")], F.lit(False).alias("is_test"), s["fragment_id"].alias("fragment_id"),
        )
        return F.when(s.isNotNull() & a.isNotNull(), record).cast(like.schema[name].dataType)

    counted = F.concat(F.col("c.n_rows").cast("string"), F.lit(" changed line(s) outside classified symbol spans."))
    exact = F.lit("Raw source lines differ outside existing change spans; blank lines and line ends count. No behavior change is inferred from this text evidence.")
    rows = flat.select("snapshot_id", "raw_id", side("before", "old_start", "old_end").alias("before"), side("after", "new_start", "new_end").alias("after"), F.col("c.kind").alias("kind"), F.when(F.col("c.raw_only"), exact).otherwise(counted).alias("basis"))
    return rows.withColumns({
        "change_id": X.stable_id(F.coalesce("before.symbol_id", F.lit("")), F.coalesce("after.symbol_id", F.lit("")), F.col("kind")), "label": labels.label(F.col("kind")),
        "signature_changed": F.lit(None).cast("boolean"), "docstring_changed": F.lit(None).cast("boolean"),
    })


def group_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): changes by path and theme; import wiring without an earlier side joins its path's largest group."""
    s = F.coalesce("after", "before")
    themed = changes.select("snapshot_id", "change_id", s["path"].alias("path"), labels.theme(F.col("kind"), s["name"], s["path"], s["is_test"]).alias("theme"), F.col("before").isNotNull().alias("has_before"), s["start"].alias("start"))
    themed = themed.withColumn("group_id", X.stable_id(F.lit("group"), F.col("path"), F.col("theme")))
    groups = themed.groupBy("snapshot_id", "group_id", "path", "theme").agg(F.count("*").alias("n"), F.max("has_before").alias("has_before"))
    parents = groups.where("theme <> 'wiring'").groupBy("snapshot_id", "path").agg(F.max_by("group_id", F.struct("n", "group_id")).alias("parent"))
    folded = groups.where("theme = 'wiring' and not has_before").join(parents, ["snapshot_id", "path"]).select("snapshot_id", "group_id", "parent")
    members = themed.join(folded, ["snapshot_id", "group_id"], "left").select("snapshot_id", F.coalesce("parent", "group_id").alias("group_id"), "change_id", "start")
    kept = groups.join(folded, ["snapshot_id", "group_id"], "left_anti").select("snapshot_id", "group_id", "path", "theme")
    name = F.element_at(F.split("path", "/"), -1)
    return kept.withColumn("title", F.concat(F.upper(F.substring("theme", 1, 1)), F.expr("substring(theme, 2)"), F.lit(" · "), name)), members


def group_edges(edges: DataFrame, symbols: DataFrame, imports: DataFrame, groups: DataFrame, members: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, test links) between groups: a consumer needs the provider of what it refers to or imports."""
    owner = changes.select("snapshot_id", "change_id", F.explode(F.array("before.symbol_id", "after.symbol_id")).alias("symbol_id")).where("symbol_id is not null").join(members, ["snapshot_id", "change_id"]).select("snapshot_id", "symbol_id", "group_id").dropDuplicates(["snapshot_id", "symbol_id"])
    provider = owner.select("snapshot_id", F.col("symbol_id").alias("target"), F.col("group_id").alias("provider"))
    consumer = owner.select("snapshot_id", F.col("symbol_id").alias("source"), F.col("group_id").alias("consumer"))
    linked = edges.join(provider, ["snapshot_id", "target"]).join(consumer, ["snapshot_id", "source"], "left")
    links = linked.where(F.col("type").startswith("test_")).select("snapshot_id", F.col("provider").alias("group_id"), F.col("source").alias("test_id"), F.col("target").alias("symbol_id"), F.col("type").alias("relationship"), F.lit(labels.NOT_RUN).alias("status"))
    first = Window.partitionBy("snapshot_id", "provider", "consumer", "type").orderBy("idx", "ord", "seq")
    direct = linked.where("consumer is not null and consumer <> provider").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("snapshot_id", "provider", "consumer", "type", "path", "line")
    wiring = groups.where("theme = 'wiring'").select("snapshot_id", "path", F.col("group_id").alias("consumer"))
    wanted = imports.where("top_level and level = 0 and name is not null and name <> '*' and side = 'head'").join(wiring, ["snapshot_id", "path"]).select("snapshot_id", "consumer", "path", "line", F.col("module").alias("suffix"), "name")
    heads = graph.module_suffixes(symbols.where("side = 'head'"))
    sole = heads.groupBy("snapshot_id", "suffix", "name").agg(F.count("*").alias("n"), F.first("target").alias("target")).where("n = 1")
    brought = wanted.join(sole, ["snapshot_id", "suffix", "name"]).join(provider, ["snapshot_id", "target"]).where("consumer <> provider")
    brought = brought.groupBy("snapshot_id", "provider", "consumer").agg(F.min(F.struct("line", "path")).alias("at")).select("snapshot_id", "provider", "consumer", F.lit("imports").alias("type"), "at.path", "at.line")
    return direct.unionByName(brought), links


def order_groups(groups: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Groups in reading order: number, next_id, prerequisites (sorted), component and in_cycle."""
    counts = imports.where("side = 'head'").groupBy("snapshot_id", "path").agg(F.count("*").alias("n_imports"))
    keyed = groups.join(counts, ["snapshot_id", "path"], "left")
    # Files of more imports come first among the wiring; the numbers are padded to the width of any count.
    weight = F.lit(10**18) - F.when(F.col("theme") == "wiring", F.coalesce("n_imports", F.lit(0))).otherwise(0)
    key = F.array(F.lpad(labels.theme_rank(F.col("theme")).cast("string"), 2, "0"), F.lpad(weight.cast("string"), 19, "0"), F.col("path"))
    nodes = keyed.select("snapshot_id", F.col("group_id").alias("node"), key.alias("key"))
    needs = edges.select("snapshot_id", F.col("consumer").alias("node"), F.col("provider").alias("needs")).distinct()
    placed = graph.order_nodes(nodes, needs).withColumnRenamed("node", "group_id")
    before = needs.groupBy("snapshot_id", F.col("node").alias("group_id")).agg(F.sort_array(F.collect_set("needs")).alias("prerequisites"))
    along = Window.partitionBy("snapshot_id").orderBy("number")
    joined = groups.join(placed, ["snapshot_id", "group_id"]).join(before, ["snapshot_id", "group_id"], "left")
    return joined.withColumns({"next_id": F.lead("group_id").over(along), "prerequisites": F.coalesce("prerequisites", F.array().cast("array<string>"))})


def narrate(groups: DataFrame) -> DataFrame:
    """Add ``why_now``: what a group builds on, or that it is a foundation."""
    names = groups.select("snapshot_id", F.col("group_id").alias("need"), F.col("title").alias("need_title"))
    flat = groups.select("snapshot_id", "group_id", F.posexplode("prerequisites").alias("i", "need")).where("i < 3").join(names, ["snapshot_id", "need"])
    titles = flat.groupBy("snapshot_id", "group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "need_title"))), lambda x: x["need_title"]), "; ").alias("_on"))
    why = (
        F.when(F.col("_on").isNotNull(), F.concat(F.lit("Build on "), F.col("_on"), F.lit(".")))
        .when(F.col("number") == 1, "Start with this foundational change.")
        .otherwise("Another foundation: no prerequisite among the changed units was resolved statically.")
    )
    return groups.join(titles, ["snapshot_id", "group_id"], "left").withColumn("why_now", why).drop("_on")


def report_stats(fragments: DataFrame, symbols: DataFrame, changes: DataFrame, groups: DataFrame, raw: DataFrame) -> DataFrame:
    """One row a snapshot: groups, units, identical_moves, supplied_paths, additions, deletions, test_definitions, test_runs."""
    rows = raw.select("snapshot_id", F.explode("residual.hunks").alias("h")).select("snapshot_id", F.explode("h.rows").alias("r"))
    lines = rows.groupBy("snapshot_id").agg(F.count_if(F.col("r.tag") == "add").alias("supplied_additions"), F.count_if(F.col("r.tag") == "delete").alias("supplied_deletions"))
    units = changes.groupBy("snapshot_id").agg(F.count("*").alias("units"), F.count_if(F.col("kind") == "moved").alias("identical_ast_moves"))
    base = fragments.groupBy("snapshot_id").agg(F.countDistinct("path").alias("supplied_paths"))
    tests = symbols.where("side = 'head' and is_test").groupBy("snapshot_id").agg(F.count("*").alias("test_definitions"))
    grouped = groups.groupBy("snapshot_id").agg(F.count("*").alias("groups"))
    out = base
    for part in (units, grouped, lines, tests):
        out = out.join(part, "snapshot_id", "left")
    return out.na.fill(0).withColumn("test_runs", F.lit(0).cast("long"))


def compile_snapshots(fragments: DataFrame, file_evidence: DataFrame, patches: DataFrame) -> Compiled:
    """Compile every snapshot of the tables. Fragments may have been delivered several times."""
    once = tables.placed_deliveries(fragments)
    parsed = materialize(extract.extract(once.select("snapshot_id", "fragment_id", "idx", "side", "path", "text", "start_line", "scope", "region", "syntax")), "compile-parsed")
    symbols = materialize(extract.symbols(parsed), "compile-symbols")
    imports = extract.imports(parsed)
    coverage = materialize(evidence.file_coverage(file_evidence, parsed.select("snapshot_id", "fragment_id", "idx", "side", "path", F.col("extraction.status").alias("status"))), "compile-coverage")
    pairs = materialize(match.match_symbols(symbols, parsed), "compile-pairs")
    declared = materialize(symbol_changes(symbols, pairs, coverage), "compile-declared")
    raw = materialize(raw_changes(parsed, file_evidence, patches, coverage, declared), "compile-raw")
    changes = materialize(declared.unionByName(residual_changes(raw, declared)).dropDuplicates(["snapshot_id", "change_id"]), "compile-changes")
    groups, members = group_changes(changes)
    members = materialize(members, "compile-members")
    heads = symbols.where("side = 'head'")
    refs = extract.references(heads)
    edges, unresolved = graph.symbol_edges(refs, heads, imports.where("side = 'head'"))
    edges = materialize(edges, "compile-edges")
    between, links = group_edges(edges, symbols, imports, groups, members, changes)
    between = materialize(between, "compile-between")
    ordered = materialize(narrate(order_groups(groups, between, imports)), "compile-groups")
    owner = changes.select("snapshot_id", "change_id", F.explode(F.array("before.symbol_id", "after.symbol_id")).alias("symbol_id")).where("symbol_id is not null").join(members.select("snapshot_id", "change_id", "group_id"), ["snapshot_id", "change_id"])
    placed = projections.order_changes(members, edges, owner.dropDuplicates(["snapshot_id", "symbol_id"]))
    notes = parsed.where("extraction.note is not null").select("snapshot_id", "idx", F.concat("path", F.lit(" ("), "side", F.lit("): "), "extraction.note").alias("note"), F.col("extraction.status").alias("status"))
    stats = report_stats(parsed, symbols, changes, ordered, raw)
    with_group = changes.join(members.select("snapshot_id", "change_id", "group_id"), ["snapshot_id", "change_id"], "left")
    return Compiled(symbols, imports, coverage, pairs, with_group, raw, ordered, placed, between, edges, unresolved, links, stats, notes)
