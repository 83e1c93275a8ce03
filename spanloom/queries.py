"""The queries of the engine's own operators over the snapshot tables, and their SQL.

Rows delivered several times count once; where a query reads deliveries themselves its name says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import labels
from spanloom.functions import text as X
from spanloom.operators import diff, evidence, extract, graph, integrity, match, packet, tables
from spanloom.plans import compile as plan
from spanloom.plans import writing
from spanloom.session import materialize, table
from spanloom.sources import snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Fragments once each, in SQL.
ONCE = "(SELECT * FROM demo QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY ingested_at NULLS LAST) = 1)"
LINES = "CASE WHEN {0} = '' THEN [] WHEN ends_with({0}, chr(10)) THEN regexp_split_to_array({0}, '\\r\\n|\\n')[:-2] ELSE regexp_split_to_array({0}, '\\r\\n|\\n') END"
TEST_PATH = "regexp_matches({0}, '(^|/)(test|tests|__tests__)/|(^|/)conftest\\.py$|(^|/)test_[^/]*$|(^|/)[^/]*(_test|_spec|\\.test|\\.spec)(\\.[^./]*)?$')"
SIDES = "(SELECT snapshot_id, rec_idx, 'base' AS side, base.path AS path, base.state AS state, base.coverage AS coverage, base.reason AS reason, head.path AS other FROM file_evidence UNION ALL SELECT snapshot_id, rec_idx, 'head', head.path, head.state, head.coverage, head.reason, base.path FROM file_evidence)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split()) if "--" not in sql else sql
        return f

    return add


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Whole fragments, once each."""
    return tables.placed_deliveries(table(spark, sf, "demo"))


def each_fragment(spark: SparkSession, sf: str, *columns: Column | str) -> DataFrame:
    """What is derived of every fragment, once each: deliveries have equal contents, so only the derived columns are shuffled."""
    return table(spark, sf, "demo").select("fragment_id", *columns).dropDuplicates(["fragment_id"])


# -- scans and tables ------------------------------------------------------------------------------
@query(f"SELECT snapshot_id, side, count(*) AS n_fragments, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM {ONCE} GROUP BY ALL")
def fragment_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments and bytes of each snapshot side, deliveries merged."""
    sizes = each_fragment(spark, sf, "snapshot_id", "side", F.octet_length("text").alias("n"))
    return sizes.groupBy("snapshot_id", "side").agg(F.count("*").alias("n_fragments"), F.sum("n").cast("long").alias("n_bytes"))


@query("SELECT fragment_id, count(*) AS deliveries, CAST(max(epoch_us(ingested_at)) - min(epoch_us(ingested_at)) AS BIGINT) AS spread_us FROM demo GROUP BY fragment_id HAVING count(*) > 1")
def redeliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Records that were delivered more than once, and how far apart."""
    t = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    return table(spark, sf, "demo").groupBy("fragment_id").agg(F.count("*").alias("deliveries"), (F.max(t) - F.min(t)).alias("spread_us")).where("deliveries > 1")


@query("SELECT snapshot_id, title, changed_files FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY ingested_at NULLS LAST) AS n FROM snapshot_meta) WHERE n = 1")
def snapshot_captures(spark: SparkSession, sf: str) -> DataFrame:
    return tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id").select("snapshot_id", "title", "changed_files")


@query(f"SELECT e.snapshot_id, e.rec_idx FROM file_evidence e WHERE NOT ({TEST_PATH.format('e.base.path')} AND {TEST_PATH.format('e.head.path')})")
def evidence_without_tests(spark: SparkSession, sf: str) -> DataFrame:
    kept = tables.without_tests(table(spark, sf, "file_evidence"), fragments(spark, sf), table(spark, sf, "patches"))[0]
    return kept.select("snapshot_id", "rec_idx")


@query(f"""WITH gone AS (SELECT * FROM file_evidence e WHERE {TEST_PATH.format('e.base.path')} AND {TEST_PATH.format('e.head.path')}),
 sides AS (SELECT snapshot_id, 'base' AS side, base.path AS path FROM gone UNION SELECT snapshot_id, 'head', head.path FROM gone)
 SELECT f.fragment_id FROM {ONCE} f ANTI JOIN sides s ON f.snapshot_id = s.snapshot_id AND f.side = s.side AND f.path = s.path""")
def fragments_without_tests(spark: SparkSession, sf: str) -> DataFrame:
    return tables.without_tests(table(spark, sf, "file_evidence"), fragments(spark, sf), table(spark, sf, "patches"))[1].select("fragment_id")


@query(f"""SELECT snapshot_id, count(*) FILTER (t) AS excluded, count(*) FILTER (NOT t) AS kept FROM
 (SELECT snapshot_id, {TEST_PATH.format('e.base.path')} AND {TEST_PATH.format('e.head.path')} AS t FROM file_evidence e) GROUP BY 1 HAVING count(*) FILTER (t) > 0""")
def test_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.without_tests(table(spark, sf, "file_evidence"), fragments(spark, sf), table(spark, sf, "patches"))[3].select("snapshot_id", "excluded", "kept")


@query(f"SELECT snapshot_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS source_bytes, count(*) AS n_fragments FROM {ONCE} GROUP BY 1")
def source_bytes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = each_fragment(spark, sf, "snapshot_id", F.octet_length("text").alias("n"))
    return sizes.groupBy("snapshot_id").agg(F.sum("n").alias("source_bytes"), F.count("*").alias("n_fragments"))


@query("SELECT snapshot_id, CAST(sum(octet_length(encode(coalesce(patch, '')))) AS BIGINT) AS patch_bytes, count(*) FILTER (patch IS NULL) AS n_unavailable FROM patches GROUP BY 1")
def patch_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.patch_bytes(table(spark, sf, "patches"))


# -- scalar functions ------------------------------------------------------------------------------
@query(f"SELECT fragment_id, sha256(text) AS digest FROM {ONCE}")
def content_digests(spark: SparkSession, sf: str) -> DataFrame:
    return each_fragment(spark, sf, X.digest(F.col("text")).alias("digest"))


@query(f"SELECT fragment_id, substring(sha256(side || chr(0) || path || chr(0) || start_line || chr(0) || coalesce(scope, 'None')), 1, 16) AS stable_id FROM {ONCE}")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers from parts, a null part reading None."""
    return each_fragment(spark, sf, X.stable_id(F.col("side"), F.col("path"), F.col("start_line"), F.col("scope")).alias("stable_id"))


@query(f"SELECT fragment_id, CAST(i + start_line - 1 AS BIGINT) AS line_no, sha256(l[i]) AS line FROM (SELECT fragment_id, start_line, {LINES.format('text')} AS l, unnest(range(1, len({LINES.format('text')}) + 1)) AS i FROM {ONCE})")
def line_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with its original number; the text as its digest."""
    rows = fragments(spark, sf).select("fragment_id", "start_line", F.posexplode(X.lines(F.col("text"))).alias("i", "line"))
    return rows.select("fragment_id", (F.col("i") + F.col("start_line")).cast("long").alias("line_no"), F.sha2("line", 256).alias("line"))


@query(f"SELECT fragment_id, CAST(len({LINES.format('text')}) AS BIGINT) AS n_lines FROM {ONCE}")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return each_fragment(spark, sf, X.line_count(F.col("text")).cast("long").alias("n_lines"))


@query(f"SELECT DISTINCT path, {TEST_PATH.format('path')} AS is_test FROM demo")
def test_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "demo").select("path", X.is_test_path(F.col("path")).alias("is_test")).distinct()


@query("SELECT DISTINCT path, regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS module FROM demo")
def module_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "demo").select("path", X.module_name(F.col("path")).alias("module")).distinct()


@query("SELECT DISTINCT path, path <> '' AND NOT regexp_matches(path, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.{1,2}([/\\\\]|$)') AS safe FROM demo")
def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "demo").select("path", X.is_safe_path(F.col("path")).alias("safe")).distinct()


@query(f"""SELECT f.fragment_id, CASE WHEN regexp_full_match(r, '[\\w.-]+/[\\w.-]+') AND regexp_full_match(s, '[0-9a-f]{{7,64}}') THEN 'https://github.com/' || r || '/blob/' || s || '/' ||
 replace(url_encode(f.path), '%2F', '/') || '#L' || f.start_line || '-L' || (f.start_line + 1) END AS link FROM {ONCE} f JOIN
 (SELECT DISTINCT ON (snapshot_id) *, FROM snapshot_meta ORDER BY snapshot_id, ingested_at) m USING (snapshot_id),
 LATERAL (SELECT CASE WHEN f.side = 'head' THEN coalesce(m.head_repository, m.repository) ELSE m.repository END AS r, CASE WHEN f.side = 'base' THEN m.base_sha ELSE m.head_sha END AS s)""")
def permalinks(spark: SparkSession, sf: str) -> DataFrame:
    meta = tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id").select("snapshot_id", "base_sha", "head_sha", "head_repository", F.col("repository").alias("repo"))
    f = fragments(spark, sf).join(meta, "snapshot_id")
    repository = F.when(F.col("side") == "head", F.coalesce("head_repository", "repo")).otherwise(F.col("repo"))
    revision = F.when(F.col("side") == "base", F.col("base_sha")).otherwise(F.col("head_sha"))
    return f.select("fragment_id", X.permalink(repository, revision, F.col("path"), F.col("start_line"), F.col("start_line") + 1).alias("link"))


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CAST(CASE WHEN t IS NULL THEN NULL WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[.!?] ')) END AS BIGINT) AS n FROM s""")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT kind, label FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in labels.LABELS.items()) + ") t(kind, label)")
def change_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Display labels of kinds: a lookup in a fixed table."""
    kinds = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in labels.LABELS])).alias("kind"))
    return kinds.select("kind", labels.label(F.col("kind")).alias("label"))


@query(f"""SELECT fragment_id, CASE WHEN len(l) > 34 THEN array_to_string(l[1:19], '|') || '|… ' || (len(l) - 24) || ' more rows …|' || array_to_string(l[-5:], '|') ELSE array_to_string(l, '|') END AS preview
 FROM (SELECT fragment_id, {LINES.format('text')} AS l FROM {ONCE})""")
def line_previews(spark: SparkSession, sf: str) -> DataFrame:
    return each_fragment(spark, sf, F.array_join(packet.preview(X.lines(F.col("text"))), "|").alias("preview"))


@query("SELECT doc_id FROM documents WHERE contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'test link table')")
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("section_id"), "text")
    return packet.search(docs, docs.select("section_id", F.col("section_id").alias("passage_id"), F.lit(1).alias("ord"), "text"), "Test link table").select(F.col("section_id").alias("doc_id"))


# -- evidence and joins ----------------------------------------------------------------------------
@query(f"SELECT snapshot_id, rec_idx, side, path, state, coverage, reason, other AS counterpart_path FROM {SIDES}")
def evidence_sides(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.evidence_sides(table(spark, sf, "file_evidence"))


@query(f"""SELECT s.snapshot_id, s.side, s.path, CAST(coalesce(f.n, 0) AS BIGINT) AS n_fragments, s.state = 'absent' AS absent, coalesce(s.state = 'supplied' AND s.coverage = 'full', false) AS full_source
 FROM {SIDES} s LEFT JOIN (SELECT snapshot_id, side, path, count(*) AS n FROM {ONCE} GROUP BY ALL) f ON s.snapshot_id = f.snapshot_id AND s.side = f.side AND s.path = f.path""")
def file_coverage(spark: SparkSession, sf: str) -> DataFrame:
    f = each_fragment(spark, sf, "snapshot_id", "idx", "side", "path", F.lit("ok").alias("status"))
    out = evidence.file_coverage(table(spark, sf, "file_evidence"), f)
    return out.select("snapshot_id", "side", "path", F.size("fragment_ids").cast("long").alias("n_fragments"), "absent", "full_source")


@query(f"""WITH s AS (SELECT DISTINCT ON (snapshot_id, side, path) e.snapshot_id, e.side, e.path, CASE WHEN e.side = 'head' THEN e.path ELSE e.other END AS head FROM {SIDES} e),
 p AS (SELECT f.snapshot_id, coalesce(f.region, s.head) AS region, f.side, f.text FROM {ONCE} f JOIN s ON f.snapshot_id = s.snapshot_id AND f.side = s.side AND f.path = s.path)
 SELECT snapshot_id, region, max(sha256(text)) FILTER (side = 'base') AS before, max(sha256(text)) FILTER (side = 'head') AS after FROM p GROUP BY 1, 2""")
def region_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = tables.regions(fragments(spark, sf), table(spark, sf, "file_evidence"))
    return out.select("snapshot_id", "region", F.sha2("before.text", 256).alias("before"), F.sha2("after.text", 256).alias("after"))


@query(f"""WITH t AS (SELECT snapshot_id, side, path, sha256(text) AS d, fragment_id FROM {ONCE} WHERE text <> ''),
 a AS (SELECT snapshot_id, path, max(fragment_id) FILTER (side = 'base') AS b, max(fragment_id) FILTER (side = 'head') AS h FROM t GROUP BY 1, 2 HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1),
 r AS (SELECT * FROM t WHERE fragment_id NOT IN (SELECT b FROM a) AND fragment_id NOT IN (SELECT h FROM a)),
 c AS (SELECT snapshot_id, d, max(fragment_id) FILTER (side = 'base') AS b, max(fragment_id) FILTER (side = 'head') AS h FROM r GROUP BY 1, 2 HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1)
 SELECT snapshot_id, 1 AS stage, b AS before, h AS after FROM a UNION ALL SELECT snapshot_id, 2, b, h FROM c""")
def staged_file_match(spark: SparkSession, sf: str) -> DataFrame:
    """Files paired by path, then, of what is left, by equal content: unique keys with removal."""
    rows = each_fragment(spark, sf, "snapshot_id", "side", F.col("fragment_id").alias("symbol_id"), "path", F.when(F.col("text") != "", F.sha2("text", 256)).alias("d")).where("d is not null")
    first = materialize(match.unique_pairs(rows, [F.col("path")]), "file-match")
    second = match.unique_pairs(match.without(rows, first), [F.col("d")])
    return first.select("snapshot_id", F.lit(1).alias("stage"), "before", "after").union(second.select("snapshot_id", F.lit(2), "before", "after"))


@query(f"""WITH t AS (SELECT snapshot_id, side, path, fragment_id FROM {ONCE}), a AS (SELECT snapshot_id, path FROM t GROUP BY 1, 2 HAVING count(*) FILTER (side = 'base') = 1 AND count(*) FILTER (side = 'head') = 1)
 SELECT t.side, count(*) AS n FROM t ANTI JOIN a ON t.snapshot_id = a.snapshot_id AND t.path = a.path GROUP BY 1""")
def unmatched_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = each_fragment(spark, sf, "snapshot_id", "side", F.col("fragment_id").alias("symbol_id"), "path")
    return match.without(rows, match.unique_pairs(rows, [F.col("path")])).groupBy("side").agg(F.count("*").alias("n"))


patch_rows_sql = """(WITH l AS (SELECT snapshot_id, path, i, string_split(patch, chr(10))[i] AS raw FROM (SELECT snapshot_id, path, patch, unnest(range(1, len(string_split(patch, chr(10))) + 1)) AS i FROM patches WHERE patch IS NOT NULL)),
 h AS (SELECT *, regexp_matches(regexp_replace(raw, '\\r$', ''), '^@@ -(\\d+)(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@') AS head FROM l),
 n AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY snapshot_id, path ORDER BY i) AS hunk FROM h),
 k AS (SELECT *, CASE WHEN head THEN NULL WHEN raw[1] = '+' THEN 'add' WHEN raw[1] = '-' THEN 'delete' ELSE 'context' END AS tag FROM n WHERE hunk > 0 AND (head OR raw[1] IN (' ', '+', '-'))),
 s AS (SELECT *, max(CASE WHEN head THEN CAST(regexp_extract(raw, '^@@ -(\\d+)', 1) AS INT) END) OVER (PARTITION BY snapshot_id, path, hunk) AS o0, max(CASE WHEN head THEN CAST(regexp_extract(raw, ' \\+(\\d+)', 1) AS INT) END) OVER (PARTITION BY snapshot_id, path, hunk) AS n0 FROM k)
 SELECT snapshot_id, path, CAST(hunk AS INT) AS hunk, tag, CASE WHEN tag <> 'add' THEN o0 + count(*) FILTER (tag IN ('context', 'delete')) OVER w - 1 END AS old, CASE WHEN tag <> 'delete' THEN n0 + count(*) FILTER (tag IN ('context', 'add')) OVER w - 1 END AS new, raw
 FROM s WINDOW w AS (PARTITION BY snapshot_id, path, hunk ORDER BY i) QUALIFY tag IS NOT NULL)"""


@query(f"SELECT snapshot_id, path, hunk, tag, CAST(old AS INT) AS old, CAST(new AS INT) AS new, sha256(raw[2:]) AS text FROM {patch_rows_sql}")
def patch_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of all patches with line numbers, by windows alone."""
    return diff.patch_lines(table(spark, sf, "patches").select("snapshot_id", "path", "patch")).select("snapshot_id", "path", "hunk", "tag", "old", "new", F.sha2("text", 256).alias("text"))


@query(f"SELECT snapshot_id, count(*) FILTER (tag = 'add') AS additions, count(*) FILTER (tag = 'delete') AS deletions FROM {patch_rows_sql} GROUP BY 1")
def patch_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = diff.patch_lines(table(spark, sf, "patches").select("snapshot_id", "path", "patch"))
    return rows.groupBy("snapshot_id").agg(F.count_if(F.col("tag") == "add").alias("additions"), F.count_if(F.col("tag") == "delete").alias("deletions"))


_RUNS = f"""(SELECT snapshot_id, path, side, min(line) AS start, max(line) AS "end" FROM (SELECT *, line - row_number() OVER (PARTITION BY snapshot_id, path, side ORDER BY line) AS g FROM
 (SELECT DISTINCT snapshot_id, path, tag AS side, CASE WHEN tag = 'delete' THEN old ELSE new END AS line FROM {patch_rows_sql} WHERE tag <> 'context')) GROUP BY snapshot_id, path, side, g)"""


@query(f'SELECT snapshot_id, path, side, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM {_RUNS}')
def changed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive changed lines of each file side."""
    rows = diff.patch_lines(table(spark, sf, "patches").select("snapshot_id", "path", "patch")).where("tag <> 'context'")
    line = F.when(F.col("tag") == "delete", F.col("old")).otherwise(F.col("new"))
    return packet.islands(rows.select("snapshot_id", "path", F.col("tag").alias("side"), line.alias("line")), ["snapshot_id", "path", "side"]).select("snapshot_id", "path", "side", "start", "end")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, path, side ORDER BY start) AS n FROM {_RUNS}), o AS (SELECT * FROM r WHERE side = 'delete'), a AS (SELECT * FROM r WHERE side = 'add')
 SELECT coalesce(o.snapshot_id, a.snapshot_id) AS snapshot_id, coalesce(o.path, a.path) AS path, CAST(coalesce(o.n, a.n) AS INT) AS n, CAST(o.start AS INT) AS old_start, CAST(o."end" AS INT) AS old_end, CAST(a.start AS INT) AS new_start, CAST(a."end" AS INT) AS new_end
 FROM o FULL JOIN a ON o.snapshot_id = a.snapshot_id AND o.path = a.path AND o.n = a.n""")
def zipped_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The i-th removed run beside the i-th added one."""
    runs = materialize(changed_runs(spark, sf), "runs")
    old, new = (runs.where(f"side = '{s}'").drop("side") for s in ("delete", "add"))
    return packet.zip_runs(old, new, ["snapshot_id", "path"]).select("snapshot_id", "path", "n", "old_start", "old_end", "new_start", "new_end")


@query(f'SELECT snapshot_id, path, side, CAST(min(start) AS INT) AS start, CAST(max("end") AS INT) AS "end" FROM {_RUNS} GROUP BY 1, 2, 3')
def changed_hulls(spark: SparkSession, sf: str) -> DataFrame:
    return packet.hull(changed_runs(spark, sf), ["snapshot_id", "path", "side"])


@query("""SELECT a.o_custkey AS custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT o_custkey, o_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) a
 JOIN (SELECT o_custkey, o_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) b ON a.o_custkey = b.o_custkey AND a.s <= b.e AND b.s <= a.e AND a.o_orderkey < b.o_orderkey""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer whose shipping times overlap: the engine's overlap join on days."""
    spans = table(spark, sf, "orders").join(table(spark, sf, "lineitem").withColumn("day", F.unix_date(F.col("l_shipdate").cast("date"))), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("custkey"), "o_orderkey").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    spans = materialize(spans, "spans")
    return packet.overlapping(spans.withColumnRenamed("o_orderkey", "a"), spans.withColumnRenamed("o_orderkey", "b"), ["custkey"]).where("a < b").select("custkey", "a", "b")


@query("SELECT user_id, array_to_string(list(event_type ORDER BY t, event_type), ',') AS items FROM (SELECT user_id, event_type, min(event_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    out = packet.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")
    return out.select("user_id", F.array_join("items", ",").alias("items"))


@query("""WITH e AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE c.c_nationkey <> s.s_nationkey GROUP BY 1, 2),
 g AS (SELECT x.a, x.b FROM e x LEFT JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.n > coalesce(y.n, 0)),
 r AS (SELECT DISTINCT a, b FROM (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM g UNION SELECT t.a, g.b FROM t JOIN g ON t.b = g.a) SELECT * FROM t))
 SELECT n.n_nationkey AS nation, least(n.n_nationkey, coalesce(min(x.b), n.n_nationkey)) AS component FROM nation n LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = n.n_nationkey GROUP BY 1""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of the graph of nations that mostly buy from one another: the engine's components on given data."""
    o, c, li, s = (table(spark, sf, n) for n in ("orders", "customer", "lineitem", "supplier"))
    e = o.join(c, o.o_custkey == c.c_custkey).join(li, li.l_orderkey == o.o_orderkey).join(s, s.s_suppkey == li.l_suppkey).where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))
    e = materialize(e, "nations")
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    edges = e.join(back, ["a", "b"], "left").where("n > coalesce(m, 0)")
    pad = lambda x: F.lpad(F.col(x).cast("string"), 3, "0")
    nodes = table(spark, sf, "nation").select(F.lit(1).alias("snapshot_id"), pad("n_nationkey").alias("node"), F.array(pad("n_nationkey")).alias("key"))
    placed = graph.order_nodes(nodes, edges.select(F.lit(1).alias("snapshot_id"), pad("a").alias("node"), pad("b").alias("needs")))
    return placed.select(F.col("node").cast("int").alias("nation"), F.col("component").cast("int").alias("component"))


@query(f"""WITH f AS (SELECT snapshot_id, side, path, count(*) AS n, min(start_line) AS first, max(CASE WHEN coalesce(scope, 'full') NOT IN ('full', 'complete') THEN scope END) AS excerpt FROM {ONCE} GROUP BY 1, 2, 3),
 b AS (SELECT coalesce(s.snapshot_id, f.snapshot_id) AS snapshot_id, coalesce(s.side, f.side) || ' ' || coalesce(s.path, f.path) AS item, s.state, s.coverage, coalesce(f.n, 0) AS n, f.first, f.excerpt FROM {SIDES} s FULL JOIN f ON s.snapshot_id = f.snapshot_id AND s.side = f.side AND s.path = f.path)
 SELECT rule, count(*) AS n FROM (SELECT 'supplied side has a fragment' AS rule FROM b WHERE state = 'supplied' AND n = 0 UNION ALL SELECT 'whole file in one fragment' FROM b WHERE state = 'supplied' AND coverage = 'full' AND n > 1
 UNION ALL SELECT 'whole file from line 1' FROM b WHERE state = 'supplied' AND coverage = 'full' AND first <> 1 UNION ALL SELECT 'whole file is no excerpt' FROM b WHERE state = 'supplied' AND coverage = 'full' AND excerpt IS NOT NULL
 UNION ALL SELECT 'no fragment without a source' FROM b WHERE state IN ('absent', 'unavailable') AND n > 0 UNION ALL SELECT 'fragment without evidence' FROM b WHERE state IS NULL
 UNION ALL SELECT 'one patch a record' FROM (SELECT snapshot_id, head.path AS path FROM file_evidence) e FULL JOIN (SELECT snapshot_id, path FROM patches) p ON e.snapshot_id = p.snapshot_id AND e.path = p.path WHERE e.path IS NULL OR p.path IS NULL) GROUP BY 1""")
def coverage_violations(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule of coverage is broken."""
    out = integrity.coverage(table(spark, sf, "file_evidence"), fragments(spark, sf), table(spark, sf, "patches"))
    return out.groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT DISTINCT ON (snapshot_id) * FROM snapshot_meta ORDER BY snapshot_id, ingested_at) SELECT f.fragment_id AS source_id, CASE WHEN f.side = 'base' THEN m.base_sha ELSE m.head_sha END AS revision, CAST(len({LINES.format('f.text')}) AS BIGINT) AS n_lines, sha256(f.text) AS digest
 FROM {ONCE} f JOIN m USING (snapshot_id)""")
def packet_sources(spark: SparkSession, sf: str) -> DataFrame:
    meta = tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id")
    return packet.sources(fragments(spark, sf), meta).select("source_id", "revision", F.col("n_lines").cast("long").alias("n_lines"), "digest")


@query(f"""SELECT fragment_id AS source_id, sha256(array_to_string(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')[2:4], '')) AS cited FROM {ONCE} WHERE len({LINES.format('text')}) >= 4""")
def cited_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines 2 to 4 of every source that has them, ends kept."""
    cited = F.when(X.line_count(F.col("text")) >= 4, F.sha2(packet.cut(F.col("text"), F.lit(1), F.lit(2), F.lit(4)), 256))
    return each_fragment(spark, sf, cited.alias("cited")).where("cited is not null").withColumnRenamed("fragment_id", "source_id")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value IS NULL) AS unreported, CAST(coalesce(sum(CAST(round(value) AS BIGINT)), 0) AS BIGINT) AS input_tokens FROM events GROUP BY 1")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over calls that reported them, and how many did not: the engine's accounting on events."""
    v = F.round("value").cast("long")
    e = table(spark, sf, "events").select("event_type", v.alias("input_tokens"), F.lit(0).cast("long").alias("cached_tokens"), v.alias("output_tokens"))
    return writing.usage_totals(e, ["event_type"]).select("event_type", "calls", "unreported", "input_tokens")


# -- Python-backed operators and the whole compilation ---------------------------------------------
@query()
def parse_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Parse status and numbers of symbols and imports of every fragment."""
    e = extract.extract(fragments(spark, sf))
    return e.select("fragment_id", F.col("extraction.status").alias("status"), F.size("extraction.symbols").alias("n_symbols"), F.size("extraction.imports").alias("n_imports"))


@query()
def symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    out = extract.symbols(extract.extract(fragments(spark, sf)))
    return out.select("snapshot_id", "symbol_id", "side", "path", "name", "node_type", "start", "end", "is_test", "fingerprint")


@query()
def import_table(spark: SparkSession, sf: str) -> DataFrame:
    return extract.imports(extract.extract(fragments(spark, sf)))


@query()
def symbol_pairs(spark: SparkSession, sf: str) -> DataFrame:
    once = fragments(spark, sf)
    return match.match_symbols(materialize(extract.symbols(extract.extract(once)), "symbols"), once)


@query()
def line_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Line differences of every region whose texts differ."""
    pairs = tables.regions(fragments(spark, sf), table(spark, sf, "file_evidence")).where("before.text <> after.text")
    ready = pairs.select("snapshot_id", "region", F.col("before.text").alias("before_text"), F.col("after.text").alias("after_text"), F.col("before.start_line").alias("first_old"), F.col("after.start_line").alias("first_new"))
    rows = diff.with_hunks(ready).select("snapshot_id", "region", F.posexplode("hunks").alias("hunk", "h"))
    return rows.select("snapshot_id", "region", "hunk", "h.old_start", "h.old_count", "h.new_start", "h.new_count")


#: The last compilation, by application and folder: its queries read the tables it has written.
_LAST: dict[tuple[str, str], plan.Compiled] = {}


def _whole(c: plan.Compiled) -> bool:
    """Whether all files that a compilation wrote are still there."""
    files = {f for df in (c.symbols, c.coverage, c.pairs, c.changes, c.raw_files, c.groups, c.members, c.group_edges, c.symbol_edges) for f in df.inputFiles()}
    spark = c.groups.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    return bool(paths) and all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def compiled(spark: SparkSession, sf: str) -> plan.Compiled:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LAST or not _whole(_LAST[key]):
        _LAST.clear()
        _LAST[key] = plan.compile_snapshots(table(spark, sf, "demo"), table(spark, sf, "file_evidence"), table(spark, sf, "patches"))
    return _LAST[key]


@query()
def compiled_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of every snapshot with its kind, evidence and group."""
    c = compiled(spark, sf).changes
    s = F.coalesce("after", "before")
    return c.select("snapshot_id", "change_id", "kind", "label", s["path"].alias("path"), s["name"].alias("name"), s["start"].alias("start"), "signature_changed", "docstring_changed", "group_id", "basis")


@query()
def compiled_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups in reading order."""
    g = compiled(spark, sf).groups
    return g.select("snapshot_id", "number", "group_id", "theme", "title", "why_now", "next_id", F.array_join("prerequisites", ",").alias("prerequisites"), "in_cycle")


@query()
def compiled_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compiled(spark, sf).stats


@query()
def compiled_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Changed regions with the changes that lie in them, and those that lie in none."""
    c = compiled(spark, sf)
    found = materialize(packet.diff_regions(c.raw_files), "regions")
    mapped = packet.changes_of_regions(found, c.changes)
    told = mapped.groupBy("snapshot_id", "region_id").agg(F.count("*").alias("n_changes"))
    alone = packet.source_only(c.changes, mapped).select("snapshot_id", F.col("change_id").alias("region_id"), F.lit(0).cast("long").alias("n_changes"))
    return told.unionByName(alone)


@query()
def writing_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of each snapshot packed for writers by bytes, a shared record counted once."""
    f = each_fragment(spark, sf, "snapshot_id", "idx", F.sha2("text", 256).alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    units = f.select("snapshot_id", F.col("fragment_id").alias("unit_id"), F.col("idx").alias("ord"), F.array(F.struct("id", "bytes")).alias("records"))
    return writing.pack_units(units, writing.SMALL_PACKET)


@query()
def canonical_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of requests built from the titles of snapshots in canonical JSON."""
    m = tables.first_delivery(table(spark, sf, "snapshot_meta"), "snapshot_id").select("snapshot_id", F.to_json(F.struct("title", "scope", "comparison"), {"ignoreNullFields": "false"}).alias("body"))
    return m.select("snapshot_id", writing.identity(F.col("body")).alias("request_key"), F.octet_length(writing.canonical(F.col("body"))).alias("request_bytes"))


@query()
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return each_fragment(spark, sf, writing.token_estimate(F.col("text"), "/opt/tokenizers/byte_bpe_50k.tiktoken").alias("n_tokens"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return compiled_groups(spark, sf)


def queries() -> dict[str, Query]:
    from spanloom import derived_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from spanloom import derived_queries  # noqa: F401

    return dict(SQL)
