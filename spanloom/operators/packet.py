"""Packets: sources stored once, everything else cites their lines; excerpts, regions and projections of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as X


def sources(fragments: DataFrame, meta: DataFrame) -> DataFrame:
    """Every fragment as a source: source_id, side, path, revision, start_line, n_lines, digest, text."""
    revision = F.when(F.col("side") == "base", F.col("base_sha")).otherwise(F.col("head_sha"))
    return fragments.join(meta.select("snapshot_id", "base_sha", "head_sha"), "snapshot_id").select(
        "snapshot_id", F.col("fragment_id").alias("source_id"), "side", "path", revision.alias("revision"), F.coalesce("start_line", F.lit(1)).alias("start_line"), X.line_count(F.col("text")).alias("n_lines"), X.digest(F.col("text")).alias("digest"), "text"
    )


def cut(text: Column, first: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text whose first line has number ``first``, ends kept."""
    kept = F.slice(X.lines_with_ends(text), F.greatest(F.lit(1), start - first + 1), F.greatest(F.lit(0), end - start + 1))
    return F.array_join(kept, "")


def resolve_citations(citations: DataFrame, sources_: DataFrame) -> DataFrame:
    """Citations with the lines they name; those that name no source of their revision are dropped."""
    s = sources_.select("snapshot_id", "source_id", "revision", "start_line", "text")
    return citations.join(s, ["snapshot_id", "source_id", "revision"]).withColumn("cited", cut(F.col("text"), F.col("start_line"), F.col("start"), F.col("end"))).drop("text", "start_line")


def hull(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The least interval around all ranges of each key."""
    return ranges.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def diff_regions(raw: DataFrame) -> DataFrame:
    """One row a hunk and side of captured patches: region_id, source_id, start, end of its changed lines."""
    flat = raw.select("snapshot_id", "raw_id", F.col("before.fragment_id").alias("b"), F.col("after.fragment_id").alias("a"), F.posexplode("residual.hunks").alias("hunk", "h"))
    rows = flat.select("snapshot_id", "raw_id", "hunk", "a", "b", F.explode("h.rows").alias("r")).where("r.tag <> 'context'")
    side = F.when(F.col("r.tag") == "delete", F.struct(F.col("b").alias("source_id"), F.col("r.old").alias("line"))).otherwise(F.struct(F.col("a").alias("source_id"), F.col("r.new").alias("line")))
    spans = rows.select("snapshot_id", "raw_id", "hunk", side.alias("s")).groupBy("snapshot_id", "raw_id", "hunk", "s.source_id").agg(F.min("s.line").alias("start"), F.max("s.line").alias("end"))
    return spans.withColumn("region_id", X.stable_id(F.col("raw_id"), F.col("hunk")))


def changes_of_regions(regions: DataFrame, changes: DataFrame) -> DataFrame:
    """Which changes lie in which regions: equal source and overlapping lines."""
    spans = changes.select("snapshot_id", "change_id", F.explode(F.array("before", "after")).alias("s")).where("s is not null").select("snapshot_id", "change_id", F.col("s.fragment_id").alias("source_id"), F.col("s.start").alias("c0"), F.col("s.end").alias("c1"))
    return regions.join(spans, ["snapshot_id", "source_id"]).where("c0 <= end and start <= c1").select("snapshot_id", "region_id", "change_id").distinct()


def source_only(changes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Changes that no region has."""
    return changes.join(mapped.select("snapshot_id", "change_id").distinct(), ["snapshot_id", "change_id"], "left_anti")


def excerpts(ranges: DataFrame, sources_: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """The least contiguous excerpt of each source that holds all its ranges, widened to whole definitions where given."""
    if definitions is not None:
        touched = ranges.join(definitions.select("snapshot_id", "source_id", F.col("start").alias("d0"), F.col("end").alias("d1")), ["snapshot_id", "source_id"]).where("d0 <= end and start <= d1")
        ranges = ranges.select("snapshot_id", "source_id", "start", "end").union(touched.select("snapshot_id", "source_id", "d0", "d1"))
    box = hull(ranges, ["snapshot_id", "source_id"])
    return box.join(sources_, ["snapshot_id", "source_id"]).withColumn("excerpt", cut(F.col("text"), F.col("start_line"), F.col("start"), F.col("end"))).drop("text")


def coverage_label(definition_start: Column, definition_end: Column, start: Column, end: Column) -> Column:
    """Whether an excerpt has a definition: full, partial or not_supplied."""
    return F.when((start <= definition_start) & (definition_end <= end), "full").when((start <= definition_end) & (definition_start <= end), "partial").otherwise("not_supplied")


def overlapping(a: DataFrame, b: DataFrame, on: list[str], width: int | None = None) -> DataFrame:
    """Pairs of intervals (start <= end) that overlap, ends included. Columns start, end and b_start, b_end.

    With ``width``, whole-numbered intervals lie in bins of that width and only those with a bin in common meet, each pair
    in the bin of its later start; so a key of very many intervals is split, and short ones do not meet all others.
    """
    b = b.withColumnsRenamed({"start": "b_start", "end": "b_end"})
    meet = "start <= b_end and b_start <= end"
    if width is None:
        return a.join(b, on).where(meet)

    def binned(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))

    joined = binned(a, "start", "end").join(binned(b, "b_start", "b_end"), [*on, "_bin"])
    return joined.where(meet).where(F.col("_bin") == F.floor(F.greatest("start", "b_start") / width)).drop("_bin")


def islands(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Runs of consecutive line numbers of each key: start, end."""
    along = Window.partitionBy(*keys).orderBy(line)
    marked = lines.select(*keys, line).distinct().withColumn("_run", F.col(line) - F.row_number().over(along))
    return marked.groupBy(*keys, "_run").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("_run")


def zip_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The i-th old run beside the i-th new run; the longer side's rest stands alone."""
    along = Window.partitionBy(*keys).orderBy("start")
    a, b = (x.withColumn("n", F.row_number().over(along)).withColumnsRenamed({"start": f"{s}_start", "end": f"{s}_end"}) for x, s in ((old, "old"), (new, "new")))
    return a.join(b, [*keys, "n"], "full_outer")


def preview(rows: Column, most: int = 34, head: int = 19, tail: int = 5) -> Column:
    """Long row lists as their first and last rows around a marker that counts the others."""
    marker = F.array(F.concat(F.lit("… "), (F.size(rows) - (head + tail)).cast("string"), F.lit(" more rows …")))
    return F.when(F.size(rows) > most, F.concat(F.slice(rows, 1, head), marker, F.slice(rows, -tail, tail))).otherwise(rows)


def cited_preview(rows: DataFrame, keys: list[str], around: int = 2) -> DataFrame:
    """Rows within ``around`` of a cited one in the same hunk, and before each gap how many were left out. rows: keys, i, cited."""
    near = Window.partitionBy(*keys).orderBy("i")
    kept = rows.withColumn("_near", F.max(F.col("cited").cast("int")).over(near.rowsBetween(-around, around))).where("_near = 1").drop("_near")
    return kept.withColumn("omitted", F.col("i") - F.coalesce(F.lag("i").over(near), F.col("i") - 1) - 1)


def atoms(regions: DataFrame, keys: list[str], by: str = "ord", mapped: str = "mapped") -> DataFrame:
    """Number of the atom of each region: unmapped ones go with the next mapped one, trailing ones with the last."""
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n = F.coalesce(F.sum(F.col(mapped).cast("int")).over(before), F.lit(0))
    return regions.withColumn("atom", F.least(n, F.greatest(F.lit(0), F.sum(F.col(mapped).cast("int")).over(whole) - 1)))


def ordered_distinct(df: DataFrame, keys: list[str], item: str, by: str) -> DataFrame:
    """Distinct items of each key in the order of their first place: one array ``items``."""
    firsts = df.groupBy(*keys, item).agg(F.min(by).alias("_by"))
    return firsts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_by", item))), lambda x: x[item]).alias("items"))


def select_exact(requested: DataFrame, stored: DataFrame, key: str = "region_id") -> DataFrame:
    """Requested records that equal the stored ones, in stored order; a row that differs is marked ``differs``."""
    names = [c for c in requested.columns if c not in ("snapshot_id", key)]
    a = requested.select("snapshot_id", key, F.struct(*names).alias("_want"))
    b = stored.select("snapshot_id", key, "ord", F.struct(*names).alias("_have"))
    return a.join(b, ["snapshot_id", key], "left").select("snapshot_id", key, "ord", F.col("_want.*"), (~F.col("_want").eqNullSafe(F.col("_have"))).alias("differs"))


def search(sections: DataFrame, passages: DataFrame, query: str, hits: int = 2) -> DataFrame:
    """Sections whose text has the query, white space and letter case aside, with at most ``hits`` of their passages."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    wanted = " ".join(query.lower().split())
    found = sections.where(flat("text").contains(wanted))
    rank = Window.partitionBy("section_id").orderBy("ord")
    told = passages.where(flat("text").contains(wanted)).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= hits)
    return found.select("section_id", F.col("text").alias("section_text")).join(told.select("section_id", "passage_id", X.excerpt(F.col("text"), wanted).alias("excerpt")), "section_id", "left")
