import pytest
from pyspark.sql import functions as F

from spanloom.functions import labels
from spanloom.operators import diff, integrity, packet, projections
from spanloom.plans import compile as plan
from spanloom.sources import snapshots


@pytest.fixture(scope="module")
def demo(spark):
    t = snapshots.demo(spark)
    return t, plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])


def test_demo_report_is_sound(spark, demo, tmp_path):
    t, c = demo
    assert {"moved", "modified", "added", "text", "wiring"} <= {r.kind for r in c.changes.collect()}
    assert integrity.report_rules(c.groups, c.group_edges, c.members, c.changes, c.stats).count() == 0
    meta = spark.createDataFrame([(1, "a" * 40, "b" * 40)], "snapshot_id long, base_sha string, head_sha string")
    sources, regions = packet.sources(t["fragments"], meta), packet.diff_regions(c.raw_files)
    assert integrity.packet_rules(sources, regions, c.raw_files).count() == 0
    assert {r.rule for r in integrity.packet_rules(sources.withColumn("text", F.lit("x")), regions.limit(0), c.raw_files).collect()} == {"digest of a source", "region of a difference"}
    snapshots.write_tables({"groups": c.groups, "stats": c.stats}, str(tmp_path / "r"))
    back = snapshots.read_reports(spark, str(tmp_path / "r"))
    assert back["groups"].count() == c.groups.count()


def test_changes_are_ordered_within_groups(spark):
    body = "def later(x):\n    return earlier(x) + 1\n\n\ndef earlier(x):\n    return x - 1\n"
    t = snapshots.from_files(spark, {}, {"m.py": body})
    c = plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])
    names = {r.change_id: r.n for r in c.changes.select("change_id", F.col("after.name").alias("n")).collect()}
    order = [names[r.change_id] for r in c.members.orderBy("number").collect() if names[r.change_id] in ("later", "earlier")]
    assert order == ["earlier", "later"]


def test_projections_of_a_report(spark, demo):
    t, c = demo
    assert "fingerprint" not in projections.public_symbols(c.symbols).columns
    evidence = {(r.side, r.path): r for r in projections.source_evidence(c.coverage, t["fragments"]).collect()}
    assert len(evidence["head", "app/core.py"].digests) == 1 and evidence["base", "app/rows.py"].digests == []
    rows = projections.rows_of_change(c.raw_files, c.changes)
    heads = projections.hunk_headers(rows).collect()
    assert rows.count() and all(h.old_count >= 0 for h in heads)
    meta = spark.createDataFrame([(1, "a" * 40, "b" * 40)], "snapshot_id long, base_sha string, head_sha string")
    sources = packet.sources(t["fragments"], meta)
    assert projections.symbol_sources(c.symbols, sources).where("source_id is null").count() == 0
    lost = c.symbols.withColumn("fragment_id", F.lit("gone"))
    assert projections.symbol_sources(lost, sources).where("source_id is null").count() == 0
    assert projections.region_sources(packet.diff_regions(c.raw_files), sources).where("ambiguous").count() == 0
    assert projections.side_evidence(c.changes, c.coverage).where("base is null and head is null").count() == 0
    assert projections.caveats(c.coverage).where("text_only").count() == 2
    (terms,) = projections.code_terms(c.symbols).collect()
    assert "app/core\\.py" in terms.pattern and terms.pattern.index("tests/test_core") < terms.pattern.index("|load")
    assert projections.item_sizes(c.groups, "group_id").where("n_bytes <= 0").count() == 0
    assert any("load" in r.summary for r in projections.group_names(c.changes, c.members).collect())
    told = {r.group_id: r for r in projections.group_narratives(c.groups, c.changes, c.members).collect()}
    themes = {r.group_id: r.theme for r in c.groups.collect()}
    assert set(told) == set(themes)
    for k, r in told.items():
        if themes[k] == "tests":
            assert r.questions == [labels.QUESTION_TESTS] and r.intent == labels.INTENT_TESTS
        if themes[k] == "wiring":
            assert r.invariants == [labels.INVARIANT_WIRING] and r.intent == labels.INTENT_WIRING
        assert r.takeaway.startswith("You have inspected ") and r.provenance == labels.PROVENANCE and r.before and r.after
    (manual,) = projections.manual_packet(c.groups, c.changes, c.test_links).collect()
    assert [g.number for g in manual.groups] == list(range(1, len(manual.groups) + 1)) and manual.tests
    assert c.raw_files.select(F.size(projections.bare_hunks(F.col("residual.hunks"))).alias("n")).where("n > 0").count() == c.raw_files.count()


def test_editor_projection_and_parts(spark):
    cite = "array<struct<source_id:string,start:int,end:int>>"
    passages = spark.createDataFrame([(1, "p", "t", "x", [("s", 1, 3)]), (1, "q", "t" * 300, "y" * 5000, [])], f"snapshot_id long, passage_id string, title string, text string, citations {cite}")
    tests = spark.createDataFrame([(1, "s", "k", 3, 9), (1, "s", "l", 4, 9)], "snapshot_id long, source_id string, test_id string, start int, end int")
    rows = {r.passage_id: r for r in projections.editor_projection(passages, tests).collect()}
    assert rows["p"].related_tests == ["k"] and rows["q"].n_citations == 0 and rows["q"].related_tests == []
    assert {r.rule for r in integrity.part_rules(passages, 100).collect()} == {"title", "prose", "size of the part"}
    checks = spark.createDataFrame([(1, "is"), (1, "was")], "snapshot_id long, excerpt string")
    about = spark.createDataFrame([(1, "this is it")], "snapshot_id long, description string")
    assert [r.item for r in integrity.reference_rules(checks, about).collect()] == ["was"]


def test_saved_hunks_are_walked_once():
    before, after = "a\nb\nc\nd\ne\nf\ng\nh\ni\n", "a\nB\nc\nd\ne\nf\ng\nh\nI\n"
    hunks = diff.diff_lines(before, after, 5, 7, 1)
    assert diff.check_hunks(before, after, hunks, 5, 7) is None
    assert diff.check_hunks(before, after, hunks[:1], 5, 7) == "changes outside the hunks"
    hunks[0]["rows"][0]["text"] = "x"
    assert diff.check_hunks(before, after, hunks, 5, 7)
