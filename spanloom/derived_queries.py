"""Queries that send derived or planted rows through the engine's operators, so that SQL can state what must come out.

Declarations come from parsed sources, which SQL does not have; here fragments stand for them, named by their files. Rules
that the tables keep are sent rows that break them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as X
from spanloom.operators import diff, evidence, extract, integrity, match, tables
from spanloom.plans import compile as plan
from spanloom.plans import documents, writing
from spanloom.queries import LINES, ONCE, SIDES, TEST_PATH, compiled, each_fragment, fragments, patch_rows_sql, query
from spanloom.session import materialize, table
from spanloom.sources import snapshots

NAME = "regexp_extract(path, '[^/]*$')"
#: A fragment's part as a change: kinds by its place in the snapshot.
KIND = "CASE WHEN idx % 5 = 0 THEN 'wiring' WHEN idx % 7 = 0 THEN 'text' WHEN idx % 11 = 0 THEN 'moved' ELSE 'modified' END"
THEME = f"""CASE WHEN {TEST_PATH.format('path')} THEN 'tests' WHEN kind = 'wiring' THEN 'wiring' WHEN kind = 'text' THEN 'supporting' WHEN regexp_matches(lower(name), '^(convert_|format_|populate_)') THEN 'value conversion'
 WHEN contains(lower(name), 'label') THEN 'label normalization' WHEN contains(lower(name), 'query') OR ends_with(name, '_GRAPH') OR regexp_matches(path, '(queries|query)\\.py$') THEN 'query construction'
 WHEN contains(lower(name), 'merge') THEN 'record merging' WHEN contains(lower(name), 'parse') THEN 'result parsing' WHEN regexp_matches(name, '^(get_|fetch_|retrieve_)') THEN 'orchestration' ELSE 'implementation' END"""
CHANGES = f"""changes AS (SELECT snapshot_id, fragment_id AS change_id, side, path, {NAME} AS name, {KIND} AS kind FROM {ONCE}),
 themed AS (SELECT *, {THEME} AS theme FROM changes), keyed AS (SELECT *, substring(sha256('group' || chr(0) || path || chr(0) || theme), 1, 16) AS own FROM themed),
 counted AS (SELECT snapshot_id, own, path, theme, count(*) AS n, bool_or(side = 'base') AS has_before FROM keyed GROUP BY ALL),
 parents AS (SELECT snapshot_id, path, arg_max(own, (n, own)) AS parent FROM counted WHERE theme <> 'wiring' GROUP BY 1, 2),
 folded AS (SELECT c.snapshot_id, c.own, p.parent FROM counted c JOIN parents p USING (snapshot_id, path) WHERE c.theme = 'wiring' AND NOT c.has_before),
 members AS (SELECT k.snapshot_id, k.change_id, coalesce(f.parent, k.own) AS group_id FROM keyed k LEFT JOIN folded f USING (snapshot_id, own)),
 kept AS (SELECT c.* FROM counted c ANTI JOIN folded f ON c.snapshot_id = f.snapshot_id AND c.own = f.own)"""


def _name() -> Column:
    return F.regexp_extract("path", "[^/]*$", 0)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every fragment as a change of its side."""
    kind = F.when(F.col("idx") % 5 == 0, "wiring").when(F.col("idx") % 7 == 0, "text").when(F.col("idx") % 11 == 0, "moved").otherwise("modified")
    side = F.struct(F.col("path"), _name().alias("name"), F.lit(False).alias("is_test"), F.col("start_line").alias("start"))
    f = each_fragment(spark, sf, "snapshot_id", "side", kind.alias("kind"), side.alias("s"))
    return f.select("snapshot_id", F.col("fragment_id").alias("change_id"), "kind", F.when(F.col("side") == "base", F.col("s")).alias("before"), F.when(F.col("side") == "head", F.col("s")).alias("after"))


@query(f"WITH {CHANGES} SELECT * FROM members")
def grouped_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every change: by path and theme, wiring without an earlier side with its path's largest group."""
    return plan.group_changes(changes(spark, sf))[1].select("snapshot_id", "change_id", "group_id")


@query(f"""WITH {CHANGES}, ranks AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate(labels.THEMES))}) t(theme, place)),
 imports AS (SELECT snapshot_id, path, count(*) AS n FROM {ONCE} WHERE side = 'head' GROUP BY 1, 2),
 placed AS (SELECT k.snapshot_id, k.own AS group_id, r.place, CASE WHEN k.theme = 'wiring' THEN -coalesce(i.n, 0) ELSE 0 END AS weight, k.path FROM kept k JOIN ranks r USING (theme) LEFT JOIN imports i USING (snapshot_id, path))
 SELECT snapshot_id, group_id, CAST(row_number() OVER w AS INT) AS number, lead(group_id) OVER w AS next_id FROM placed WINDOW w AS (PARTITION BY snapshot_id ORDER BY place, weight, encode(path), group_id)""")
def numbered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups without prerequisites in reading order, each with the one that follows."""
    groups, _ = plan.group_changes(changes(spark, sf))
    none = groups.select("snapshot_id", F.col("group_id").alias("consumer"), F.col("group_id").alias("provider")).where("false")
    out = plan.order_groups(groups, none, each_fragment(spark, sf, "snapshot_id", "side", "path"))
    return out.select("snapshot_id", "group_id", "number", "next_id")


@query(f"""WITH {CHANGES}, rows AS (SELECT snapshot_id, count(*) FILTER (tag = 'add') AS a, count(*) FILTER (tag = 'delete') AS d FROM {patch_rows_sql} GROUP BY 1)
 SELECT f.snapshot_id, f.n AS supplied_paths, coalesce(u.n, 0) AS units, coalesce(u.m, 0) AS identical_ast_moves, coalesce(g.n, 0) AS groups, coalesce(r.a, 0) AS supplied_additions, coalesce(r.d, 0) AS supplied_deletions, f.t AS test_definitions
 FROM (SELECT snapshot_id, count(DISTINCT path) AS n, count(*) FILTER (side = 'head' AND {TEST_PATH.format('path')}) AS t FROM {ONCE} GROUP BY 1) f LEFT JOIN (SELECT snapshot_id, count(*) AS n, count(*) FILTER (kind = 'moved') AS m FROM changes GROUP BY 1) u USING (snapshot_id)
 LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM kept GROUP BY 1) g USING (snapshot_id) LEFT JOIN rows r USING (snapshot_id)""")
def stats_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The stats of a report over derived changes, groups and test definitions, and the rows of the given patches."""
    told = changes(spark, sf)
    groups, _ = plan.group_changes(told)
    once = each_fragment(spark, sf, "snapshot_id", "side", "path", X.is_test_path(F.col("path")).alias("is_test"))
    rows = diff.patch_lines(table(spark, sf, "patches").select("snapshot_id", "path", "patch")).groupBy("snapshot_id", "path").agg(F.collect_list(F.struct("tag")).alias("rows"))
    raw = rows.select("snapshot_id", F.struct(F.array(F.struct("rows")).alias("hunks")).alias("residual"))
    return plan.report_stats(once, once, told, groups, raw).drop("test_runs")


STATUS = "CASE WHEN NOT ends_with(path, '.py') THEN 'text_only' WHEN idx % 11 = 0 THEN 'failed' ELSE 'ok' END"
REASONS = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.UNAVAILABLE.items()) + " END"


def _blockers(side: str) -> str:
    """What a side lacks, in SQL, from its columns with the prefix ``side_``."""
    s = side[0]
    partial, unparsed, text_only = (x.format(side).rstrip(".") for x in (labels.PARTIAL, labels.UNPARSED, labels.TEXT_ONLY))
    return f"""CASE WHEN {s}_state = 'absent' THEN [] WHEN {s}_state = 'unavailable' THEN ['The {side} ' || {s}_why] ELSE
 list_filter([CASE WHEN coalesce({s}_coverage, 'full') <> 'full' THEN '{partial}' END, CASE WHEN list_contains({s}_statuses, 'failed') THEN '{unparsed}' END, CASE WHEN list_contains({s}_statuses, 'text_only') THEN '{text_only}' END], lambda x: x IS NOT NULL) END"""


@query(f"""WITH f AS (SELECT snapshot_id, side, path, list({STATUS} ORDER BY idx, fragment_id) AS statuses FROM {ONCE} GROUP BY ALL),
 c AS (SELECT s.*, coalesce(f.statuses, []) AS statuses, {REASONS} AS why, coalesce(s.state = 'supplied' AND s.coverage = 'full', false) AND coalesce(f.statuses, []) = ['ok'] AS whole FROM {SIDES} s LEFT JOIN f USING (snapshot_id, side, path)),
 d AS (SELECT snapshot_id, side, path, fragment_id, {NAME} AS name FROM {ONCE}),
 j AS (SELECT d.*, o.other, o.whole AND (t.state = 'absent' OR t.whole) AS fit, t.state = 'absent' AS gone, EXISTS (SELECT 1 FROM d x WHERE x.snapshot_id = d.snapshot_id AND x.side <> d.side AND x.path = o.other AND x.name = d.name) AS remains,
  {", ".join(f"CASE WHEN d.side = '{side}' THEN o.{c} ELSE t.{c} END AS {side[0]}_{c}" for side in ("base", "head") for c in ("state", "coverage", "statuses", "why"))}
  FROM d LEFT JOIN c o USING (snapshot_id, side, path) LEFT JOIN c t ON t.snapshot_id = d.snapshot_id AND t.side <> d.side AND t.path = o.other),
 k AS (SELECT *, coalesce(fit, false) AND NOT remains AS confirmed, array_to_string(list_concat(list_concat({_blockers('base')}, {_blockers('head')}), CASE WHEN remains THEN ['{labels.REMAINS.rstrip('.')}'] ELSE [] END), ' ') AS reason FROM j)
 SELECT fragment_id, remains AS declaration_remains, CASE WHEN confirmed THEN CASE side WHEN 'base' THEN 'removed' ELSE 'added' END ELSE 'observed_' || side END AS kind,
 CASE WHEN confirmed THEN 'Definition ' || name || CASE side WHEN 'base' THEN ' was removed from' ELSE ' was added to' END || ' the supplied file ' || path || '. ' || CASE WHEN NOT gone THEN '{labels.BOTH_PARSED}' WHEN side = 'base' THEN '{labels.ABSENT_HEAD}' ELSE '{labels.ABSENT_BASE}' END || '{labels.ELSEWHERE}'
 ELSE 'Definition ' || name || ' is present in the supplied ' || side || ' source for ' || path || '. ' || CASE side WHEN 'base' THEN 'Removal' ELSE 'Addition' END || ' from this file is unresolved: ' || reason || '.' END
 || CASE WHEN path <> other THEN ' Base path: ' || CASE side WHEN 'base' THEN path ELSE other END || '. Head path: ' || CASE side WHEN 'base' THEN other ELSE path END || '.' ELSE '' END AS basis FROM k""")
def definition_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What the evidence says of every fragment's definition: its kind, and why, in words."""
    status = F.when(~F.col("path").endswith(".py"), "text_only").when(F.col("idx") % 11 == 0, "failed").otherwise("ok")
    f = materialize(each_fragment(spark, sf, "snapshot_id", "side", "path", "idx", status.alias("status"), _name().alias("name"), F.lit("FunctionDef").alias("node_type")), "definitions")
    told = evidence.definition_evidence(f.drop("idx", "status"), f, evidence.file_coverage(table(spark, sf, "file_evidence"), f))
    return told.select("fragment_id", "declaration_remains", "kind", "basis")


@query(f"""WITH s AS (SELECT snapshot_id, side, fragment_id AS id, path, {NAME} AS name, CASE WHEN ends_with(path, '.py') THEN 'FunctionDef' WHEN ends_with(path, '.go') THEN 'ClassDef' ELSE 'Assign' END AS node_type, sha256(text) AS e, sha256(regexp_replace(text, '^[^\\n]*\\n?', '')) AS r FROM {ONCE}),
 p1 AS (SELECT snapshot_id, max(id) FILTER (side = 'base') AS before, max(id) FILTER (side = 'head') AS after FROM s GROUP BY snapshot_id, path, name, node_type HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1),
 l1 AS (SELECT * FROM s WHERE id NOT IN (SELECT before FROM p1 UNION ALL SELECT after FROM p1)),
 p2 AS (SELECT snapshot_id, max(id) FILTER (side = 'base') AS before, max(id) FILTER (side = 'head') AS after FROM l1 GROUP BY snapshot_id, name, e HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1),
 l2 AS (SELECT * FROM l1 WHERE id NOT IN (SELECT before FROM p2 UNION ALL SELECT after FROM p2)),
 p3 AS (SELECT snapshot_id, max(id) FILTER (side = 'base') AS before, max(id) FILTER (side = 'head') AS after FROM l2 WHERE node_type <> 'Assign' GROUP BY snapshot_id, r HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1)
 SELECT 1 AS stage, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3""")
def staged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The first three stages of matching, over fragments whose texts stand for trees and whose first lines stand for names."""
    kind = F.when(F.col("path").endswith(".py"), "FunctionDef").when(F.col("path").endswith(".go"), "ClassDef").otherwise("Assign")
    f = each_fragment(
        spark, sf, "snapshot_id", "side", F.col("fragment_id").alias("symbol_id"), "path", _name().alias("name"), kind.alias("node_type"), F.sha2("text", 256).alias("fingerprint"),
        F.sha2(F.regexp_replace("text", r"\A[^\n]*\n?", ""), 256).alias("rename_fingerprint"), F.lit(0).alias("ord"),
    )
    return match.match_symbols(f, f.withColumn("text", F.lit(""))).where("stage < 4").select("stage", "snapshot_id", "before", "after")


@query(f"SELECT fragment_id FROM {ONCE} WHERE NOT ends_with(path, '.py') OR syntax = 'text' OR contains(replace(text, chr(13) || chr(10), ''), chr(13))")
def text_only_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments that are not parsed, by the extraction itself."""
    return extract.extract(fragments(spark, sf)).where("extraction.status = 'text_only'").select("fragment_id")


# -- planted violations ----------------------------------------------------------------------------
BAD = f"""f AS (SELECT * REPLACE (CASE WHEN idx = 3 THEN '/' || path ELSE path END AS path, CASE WHEN idx = 4 THEN 'left' ELSE side END AS side, CASE WHEN idx = 5 THEN 0 ELSE start_line END AS start_line) FROM {ONCE}),
 m AS (SELECT DISTINCT ON (snapshot_id) * REPLACE (CASE WHEN snapshot_id % 9 = 0 THEN 'zz' ELSE base_sha END AS base_sha) FROM snapshot_meta ORDER BY snapshot_id, ingested_at),
 e AS (SELECT * FROM file_evidence UNION ALL SELECT * FROM file_evidence WHERE rec_idx = 0), p AS (SELECT * FROM patches UNION ALL SELECT * FROM patches WHERE ends_with(path, '.go')),
 s AS (SELECT snapshot_id, 'base' AS side, base.path AS path FROM e UNION ALL SELECT snapshot_id, 'head', head.path FROM e)"""


@query(f"""WITH {BAD}, v AS (SELECT 'safe path' AS rule FROM f WHERE path = '' OR regexp_matches(path, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.{{1,2}}([/\\\\]|$)') UNION ALL SELECT 'revision side' FROM f WHERE side NOT IN ('base', 'head') UNION ALL SELECT 'start line' FROM f WHERE start_line < 1
 UNION ALL SELECT 'revisions' FROM m WHERE NOT regexp_matches(base_sha, '^[0-9a-f]{{7,64}}$') OR NOT regexp_matches(head_sha, '^[0-9a-f]{{7,64}}$') UNION ALL SELECT 'one patch a path' FROM (SELECT 1 FROM p GROUP BY snapshot_id, path HAVING count(*) > 1)
 UNION ALL SELECT 'one record a side' FROM (SELECT 1 FROM s GROUP BY snapshot_id, side, path HAVING count(*) > 1) UNION ALL SELECT 'not absent on both sides' FROM e WHERE base.state = 'absent' AND head.state = 'absent'
 UNION ALL SELECT 'content unless nothing changed' FROM m ANTI JOIN e ON m.snapshot_id = e.snapshot_id WHERE coalesce(m.changed_files, 1) <> 0) SELECT rule, count(*) AS n FROM v GROUP BY 1""")
def planted_snapshot_faults(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule of a snapshot's envelope is broken by planted rows."""
    f = fragments(spark, sf).withColumns({
        "path": F.when(F.col("idx") == 3, F.concat(F.lit("/"), "path")).otherwise(F.col("path")), "side": F.when(F.col("idx") == 4, "left").otherwise(F.col("side")), "start_line": F.when(F.col("idx") == 5, 0).otherwise(F.col("start_line")),
    })
    meta = tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id").withColumn("base_sha", F.when(F.col("snapshot_id") % 9 == 0, "zz").otherwise(F.col("base_sha")))
    e, p = table(spark, sf, "file_evidence"), table(spark, sf, "patches")
    out = integrity.snapshot(meta, f, e.unionByName(e.where("rec_idx = 0")), p.unionByName(p.where(F.col("path").endswith(".go"))))
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT snapshot_id, side, path, fragment_id, start_line, text FROM {ONCE} UNION ALL SELECT snapshot_id, side, path, fragment_id || '+', start_line + 1, text FROM {ONCE} WHERE idx % 3 = 0)
 SELECT snapshot_id, side, path, fragment_id FROM (SELECT *, max("end") OVER (PARTITION BY snapshot_id, side, path ORDER BY start, "end", fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM
 (SELECT snapshot_id, side, path, fragment_id, start_line AS start, start_line + len({LINES.format('text')}) - 1 AS "end" FROM f WHERE text <> '')) WHERE reached >= start""")
def planted_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Excerpts that overlap: a third of the fragments come again one line further down."""
    f = fragments(spark, sf)
    again = f.where("idx % 3 = 0").withColumns({"fragment_id": F.concat("fragment_id", F.lit("+")), "start_line": F.col("start_line") + 1})
    return integrity.overlapping_ranges(f.unionByName(again)).select("snapshot_id", "side", "path", "fragment_id")


@query(f"""WITH listed AS (SELECT fragment_id AS path, idx, sha256(text) AS digest FROM {ONCE}), found AS (SELECT path, CASE WHEN idx % 10 = 1 THEN reverse(digest) ELSE digest END AS digest FROM listed WHERE idx % 10 <> 0 UNION ALL SELECT 'new-' || path, digest FROM listed WHERE idx = 2)
 SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unlisted' ELSE 'changed' END AS fault FROM listed l FULL JOIN found f ON l.path = f.path WHERE l.digest IS DISTINCT FROM f.digest""")
def planted_manifest_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that are missing, changed or unlisted where a tenth each was taken away, altered and added."""
    listed = each_fragment(spark, sf, "idx", X.digest(F.col("text")).alias("digest")).withColumnRenamed("fragment_id", "path")
    found = listed.where("idx % 10 <> 0").withColumn("digest", F.when(F.col("idx") % 10 == 1, F.reverse("digest")).otherwise(F.col("digest")))
    found = found.unionByName(listed.where("idx = 2").withColumn("path", F.concat(F.lit("new-"), "path")))
    return snapshots.verify_manifest(listed.drop("idx"), found.drop("idx"))


@query(f"""WITH f AS (SELECT snapshot_id, CASE WHEN idx = 1 THEN upper(fragment_id) || '!' ELSE fragment_id END AS id, CASE WHEN idx = 2 THEN -start_line ELSE start_line END AS line, CASE WHEN idx = 3 THEN 'both' ELSE side END AS side FROM {ONCE})
 SELECT rule, count(*) AS n FROM (SELECT 'identifier id' AS rule FROM f WHERE NOT regexp_matches(id, '^[0-9a-f]{{16}}$') UNION ALL SELECT 'number line' FROM f WHERE line < 0 UNION ALL SELECT 'tag side' FROM f WHERE side NOT IN ('base', 'head')) GROUP BY 1""")
def planted_field_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers, numbers and tags out of their forms."""
    own = F.col("fragment_id")
    f = each_fragment(
        spark, sf, "snapshot_id", F.when(F.col("idx") == 1, F.concat(F.upper(own), F.lit("!"))).otherwise(own).alias("id"),
        F.when(F.col("idx") == 2, -F.col("start_line")).otherwise(F.col("start_line")).alias("line"), F.when(F.col("idx") == 3, "both").otherwise(F.col("side")).alias("side"),
    )
    return integrity.field_rules(f, ["id"], ["line"], {"side": ["base", "head"]}).groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE a AS (SELECT snapshot_id, CAST(dense_rank() OVER (PARTITION BY snapshot_id ORDER BY encode(path)) AS INT) AS ord, octet_length(encode(coalesce(patch, ''))) AS bytes FROM patches),
 t AS (SELECT snapshot_id, ord, 0 AS part, bytes AS held FROM a WHERE ord = 1
 UNION ALL SELECT a.snapshot_id, a.ord, CASE WHEN t.held > 0 AND t.held + a.bytes > 4096 THEN t.part + 1 ELSE t.part END, CASE WHEN t.held > 0 AND t.held + a.bytes > 4096 THEN a.bytes ELSE t.held + a.bytes END FROM t JOIN a ON a.snapshot_id = t.snapshot_id AND a.ord = t.ord + 1)
 SELECT snapshot_id, ord, part FROM t""")
def writing_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of snapshots whose patches exceed a limit, cut between files only."""
    p = table(spark, sf, "patches").select("snapshot_id", F.dense_rank().over(Window.partitionBy("snapshot_id").orderBy("path")).alias("ord"), F.octet_length(F.coalesce("patch", F.lit(""))).cast("long").alias("bytes"))
    return writing.split_atoms(p, 4096, ["snapshot_id"])


@query(f"""WITH m AS (SELECT DISTINCT snapshot_id FROM snapshot_meta), f AS (SELECT snapshot_id, count(*) AS n, CAST(sum(len({LINES.format('text')})) AS BIGINT) AS k FROM {ONCE} GROUP BY 1), e AS (SELECT snapshot_id, count(*) AS n FROM file_evidence GROUP BY 1)
 SELECT snapshot_id, coalesce(f.n, 0) AS n_sources, coalesce(f.k, 0) AS n_lines, coalesce(e.n, 0) AS n_records, 12 AS n_fields FROM m LEFT JOIN f USING (snapshot_id) LEFT JOIN e USING (snapshot_id)""")
def packet_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the packets of the compiled snapshots hold of the given tables."""
    meta = tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id").select("snapshot_id", "repository", "base_sha", "head_sha", "title", "description")
    p = documents.packets(compiled(spark, sf), fragments(spark, sf), table(spark, sf, "file_evidence"), meta)
    n_lines = F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["n_lines"])
    return p.select("snapshot_id", F.size("sources").cast("long").alias("n_sources"), n_lines.alias("n_lines"), F.size("file_evidence").cast("long").alias("n_records"), F.lit(len(p.columns) - 1).alias("n_fields"))


@query(f"""WITH f AS (SELECT snapshot_id, side, path, region, fragment_id FROM {ONCE} UNION ALL SELECT snapshot_id, side, path, region, fragment_id || '+' FROM {ONCE} WHERE idx % 4 = 0),
 e AS (SELECT snapshot_id, rec_idx, 'base' AS side, base.path AS path, base.coverage AS coverage, head.path AS head_path FROM file_evidence UNION ALL SELECT snapshot_id, rec_idx, 'head', head.path, head.coverage, head.path FROM file_evidence),
 p AS (SELECT f.snapshot_id, f.side, coalesce(CASE WHEN f.side = 'base' AND e.rec_idx % 6 = 5 THEN 'r' ELSE f.region END, e.head_path) AS region, e.rec_idx, e.coverage FROM f JOIN e USING (snapshot_id, side, path))
 SELECT rule, count(*) AS n FROM (SELECT 'one fragment a region and side' AS rule FROM (SELECT 1 FROM p GROUP BY snapshot_id, region, side HAVING count(*) > 1) UNION ALL SELECT 'region of one record' FROM (SELECT 1 FROM p GROUP BY snapshot_id, region HAVING count(DISTINCT rec_idx) > 1)
 UNION ALL SELECT 'whole sides share a region' FROM (SELECT 1 FROM p WHERE coverage = 'full' GROUP BY snapshot_id, rec_idx HAVING count(DISTINCT region) > 1)) GROUP BY 1""")
def planted_region_faults(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule of regions is broken: a quarter of the fragments come again, and base sides of some records share one region."""
    e = table(spark, sf, "file_evidence")
    f = each_fragment(spark, sf, "snapshot_id", "side", "path", "region", "idx")
    f = f.unionByName(f.where("idx % 4 = 0").withColumn("fragment_id", F.concat("fragment_id", F.lit("+"))))
    marked = e.where("rec_idx % 6 = 5").select("snapshot_id", F.col("base.path").alias("path"), F.lit("base").alias("side"), F.lit("r").alias("_r")).distinct()
    f = f.join(marked, ["snapshot_id", "path", "side"], "left").withColumn("region", F.coalesce("_r", "region")).drop("_r")
    return integrity.region_rules(f, e).groupBy("rule").agg(F.count("*").alias("n"))
