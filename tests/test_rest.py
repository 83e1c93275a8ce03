import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import diff, integrity, packet
from spanloom.plans import compile as plan
from spanloom.plans import runs, writing
from spanloom.sources import snapshots
from spanloom.streaming import deliveries


def git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_git_source_reads_commits_only(spark, tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "old.txt").write_text("gone\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    (tmp_path / "a.py").write_bytes("x = 2\r\ny = 'ü'".encode())
    (tmp_path / "old.txt").unlink()
    (tmp_path / "b.bin").write_bytes(b"\0\2")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "t.py").write_text("t\n")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "two")
    (tmp_path / "a.py").write_text("dirty\n")
    t = snapshots.read_git(spark, str(tmp_path), "HEAD~1", "HEAD")
    evidence = {r.head.path: (r.base.state, r.head.state, r.head.reason) for r in t["file_evidence"].collect()}
    assert evidence == {"a.py": ("supplied", "supplied", None), "b.bin": ("unavailable", "unavailable", "binary_or_non_utf8"), "old.txt": ("supplied", "absent", None)}
    texts = {(r.side, r.path): r.text for r in t["fragments"].collect()}
    assert texts["head", "a.py"] == "x = 2\r\ny = 'ü'"
    patches = {r.path: r.patch for r in t["patches"].collect()}
    assert patches["a.py"].startswith("diff --git a/a.py") and {r.warning for r in t["warnings"].collect()} == {f"Skipped {s} b.bin: binary_or_non_utf8" for s in ("base", "head")}
    with pytest.raises(ValueError, match="bytes"):
        snapshots.read_git(spark, str(tmp_path), "HEAD~1", "HEAD", most_bytes=10)
    assert patches["b.bin"] is None and diff.bind_patch(patches["a.py"], texts["base", "a.py"], texts["head", "a.py"])
    c = plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])
    assert {r.residual.patch_status for r in c.raw_files.collect()} == {"captured"}


def test_snapshot_documents_round_trip(spark, tmp_path):
    t = snapshots.from_files(spark, {"a.py": "x\r\n"}, {"a.py": "y ü\n", "b.py": ""})
    meta = spark.createDataFrame([(1, "own.snapshot.v1", "a" * 40, "b" * 40)], "snapshot_id long, schema_tag string, base_sha string, head_sha string")
    docs = snapshots.snapshot_documents(meta, t["fragments"], t["file_evidence"], t["patches"])
    snapshots.write_json(docs.drop("snapshot_id"), str(tmp_path / "out"))
    back = snapshots.snapshot_tables(snapshots.read_snapshots(spark, str(tmp_path / "out" / "*.txt")))
    assert {(r.side, r.path, r.text) for r in back["fragments"].collect()} == {("base", "a.py", "x\r\n"), ("head", "a.py", "y ü\n"), ("head", "b.py", "")}
    assert back["patches"].count() == 2 and back["file_evidence"].count() == 2
    with pytest.raises(Exception):
        snapshots.write_json(docs.drop("snapshot_id"), str(tmp_path / "small"), 10)


def test_manifest_and_forbidden_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("a")
    (tmp_path / "d" / "key.pem").write_text("-----BEGIN PRIVATE KEY-----")
    found = snapshots.files(spark, str(tmp_path / "d")).cache()
    listed = found.select("path", "digest")
    assert snapshots.verify_manifest(listed, found).count() == 0
    other = listed.withColumn("digest", F.when(F.col("path") == "a.txt", "0").otherwise(F.col("digest"))).where("path <> 'key.pem'")
    assert {(r.path, r.fault) for r in snapshots.verify_manifest(other, found).collect()} == {("a.txt", "changed"), ("key.pem", "unlisted")}
    assert {r.path: set(r.faults) for r in snapshots.forbidden_files(found, [r"\.txt$"]).collect()} == {"key.pem": {"name", "credential file", "credential"}}


def test_recorded_pull_request(spark, tmp_path):
    record = {
        "base_sha": "a" * 40, "head_sha": "b" * 40, "repository": "o/n", "changed_files": 2,
        "files": [
            {"filename": "new.py", "previous_filename": "old.py", "status": "renamed", "patch": "@@ -1 +1 @@\n-x\n+y", "base": snapshots.encode_content("x\n"), "head": snapshots.encode_content("y\n")},
            {"filename": "big.bin", "status": "added", "patch": None, "base": None, "head": {"type": "file", "encoding": "base64", "size": 99, "content": "AAE="}},
        ],
    }
    (tmp_path / "p.json").write_text(json.dumps(record))
    t = snapshots.recorded_pull(spark, str(tmp_path / "p.json"))
    rows = {r.head.path: (r.base.path, r.base.state, r.head.state, r.head.reason) for r in t["file_evidence"].collect()}
    assert rows == {"new.py": ("old.py", "supplied", "supplied", None), "big.bin": ("big.bin", "absent", "unavailable", "invalid_content_size")}
    (tmp_path / "p.json").write_text(json.dumps({**record, "head_again": "c" * 40}))
    with pytest.raises(Exception, match="moved"):
        snapshots.recorded_pull(spark, str(tmp_path / "p.json"))["file_evidence"].collect()


def test_synthetic_snapshot_compiles(spark):
    t = snapshots.synthetic(spark, 4, 10)
    c = plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])
    assert {r.residual.patch_status for r in c.raw_files.collect()} == {"captured"} and c.raw_files.count() == 4
    (s,) = c.stats.collect()
    assert (s.supplied_additions, s.supplied_deletions) == (4, 4)


def test_integrity_rules(spark):
    t = snapshots.from_files(spark, {"a.py": "x"}, {"a.py": "y"})
    assert integrity.coverage(t["file_evidence"], t["fragments"], t["patches"]).count() == 0
    assert integrity.region_rules(t["fragments"], t["file_evidence"]).count() == 0
    twice = t["fragments"].unionByName(t["fragments"].withColumn("start_line", F.lit(2)))
    rules = {r.rule for r in integrity.coverage(t["file_evidence"], twice, t["patches"].limit(0)).collect()}
    assert {"whole file in one fragment", "one patch a record"} <= rules
    assert {r.rule for r in integrity.region_rules(twice, t["file_evidence"]).collect()} == {"one fragment a region and side"}
    spans = spark.createDataFrame([(1, "base", "p", "1", 1, "a\nb\n"), (1, "base", "p", "2", 2, "c\n"), (1, "base", "p", "3", 3, "d"), (1, "base", "p", "4", 1, "")], "snapshot_id long, side string, path string, fragment_id string, start_line int, text string")
    assert [r.fragment_id for r in integrity.overlapping_ranges(spans).collect()] == ["2"]
    with pytest.raises(Exception, match="integrity"):
        integrity.enforce(integrity.coverage(t["file_evidence"], twice, t["patches"])).collect()


def test_order_and_partition_rules(spark):
    groups = spark.createDataFrame([(1, "a", 1, "a"), (1, "b", 2, "b"), (1, "c", 4, "c")], "snapshot_id long, group_id string, number int, component string")
    edges = spark.createDataFrame([(1, "b", "a")], "snapshot_id long, provider string, consumer string")
    assert {r.rule for r in integrity.order_rules(groups, edges).collect()} == {"numbers are a permutation", "prerequisite first"}
    parts = spark.createDataFrame([(1, "x"), (1, "x"), (1, "z")], "s int, i string")
    whole = spark.createDataFrame([(1, "x"), (1, "y")], "s int, i string")
    assert {(r.i, r.fault) for r in integrity.exact_partition(parts, whole, "s", "i").collect()} == {("x", "repeated"), ("y", "missing"), ("z", "added")}
    assert {(r.i, r.only_in) for r in integrity.same_rows(parts, whole).collect()} == {("x", "first"), ("z", "first"), ("y", "second")}


def test_stories_and_citations(spark):
    sources = spark.createDataFrame([(1, "s", "r", 10, 5)], "snapshot_id long, source_id string, revision string, start_line int, n_lines int")
    cites = spark.createDataFrame([(1, "p", "s", "r", 10, 14), (1, "p", "s", "q", 10, 11), (1, "p", "s", "r", 9, 9), (1, "p", "t", "r", 1, 1)], "snapshot_id long, passage_id string, source_id string, revision string, start int, end int")
    assert sorted(r.rule for r in integrity.citation_rules(cites, sources).collect()) == ["citation inside its source", "cited source is there", "revision of a citation"]
    passages = spark.createDataFrame([(1, "p", "t", "x", ["c1"], ["r1"])], "snapshot_id long, passage_id string, title string, text string, change_ids array<string>, region_ids array<string>")
    changes = spark.createDataFrame([(1, "c1"), (1, "c2")], "snapshot_id long, change_id string")
    regions = spark.createDataFrame([(1, "r1", "s", 14, 20), (1, "r2", "s", 1, 2)], "snapshot_id long, region_id string, source_id string, start int, end int")
    assert {(r.rule, r.item) for r in integrity.story_rules(passages, cites, changes, regions).collect()} == {("change is told", "c2"), ("region is told", "r2")}


def test_packet_pieces(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 4)], "k int, line int")
    assert {(r.start, r.end) for r in packet.islands(rows, ["k"]).collect()} == {(1, 2), (4, 4)}
    src = spark.createDataFrame([(1, "s", 5, "a\r\nb\nc")], "snapshot_id long, source_id string, start_line int, text string")
    want = spark.createDataFrame([(1, "s", 6, 6), (1, "s", 7, 7)], "snapshot_id long, source_id string, start int, end int")
    assert packet.excerpts(want, src).first().excerpt == "b\nc"
    defs = spark.createDataFrame([(1, "s", 5, 6)], "snapshot_id long, source_id string, start int, end int")
    assert packet.excerpts(want, src, defs).first().excerpt == "a\r\nb\nc"
    shown = spark.createDataFrame([(1, i, i == 5) for i in range(10)], "h int, i int, cited boolean")
    assert [(r.i, r.omitted) for r in packet.cited_preview(shown, ["h"]).orderBy("i").collect()] == [(i, 0) for i in range(3, 8)]
    at = spark.createDataFrame([(1, i, m) for i, m in enumerate([False, True, False, True, False])], "k int, ord int, mapped boolean")
    assert [r.atom for r in packet.atoms(at, ["k"]).orderBy("ord").collect()] == [0, 0, 1, 1, 1]


def test_strict_and_canonical_json(spark):
    assert writing.canonical_json({"b": [1, "ü"], "a": None}) == '{"a":null,"b":[1,"ü"]}'
    for bad in ('{"a":1,"a":2}', "NaN", "[1e999]", '"\\ud800"', "{"):
        with pytest.raises(ValueError):
            writing.strict_json(bad)
    df = spark.createDataFrame([('{"b":1, "a":2}',), ('{"a":2,"b":1}',), ("{",), (None,)], "t string")
    ids = [r.i for r in df.select(writing.identity(F.col("t")).alias("i")).collect()]
    assert ids[0] == ids[1] and ids[2] is None and ids[3] is None


def test_packing_counts_shared_records_once(spark):
    rec = "array<struct<id:string,bytes:bigint>>"
    rows = [(1, f"u{i}", i, [("shared", 50), (f"r{i}", 10)]) for i in range(8)] + [(1, "huge", 9, [("h", 500)])]
    units = spark.createDataFrame(rows, f"snapshot_id long, unit_id string, ord int, records {rec}")
    out = {r.unit_id: r for r in writing.pack_units(units, 100).collect()}
    assert out["huge"].writer is None and all(out[f"u{i}"].load <= 100 for i in range(8)) and len({out[f"u{i}"].writer for i in range(8)}) <= 4
    parts = writing.split_atoms(spark.createDataFrame([(1, i, b) for i, b in enumerate([40, 70, 20, 300, 5])], "k int, ord int, bytes long"), 100, ["k"]).orderBy("ord").collect()
    assert [r.part for r in parts] == [0, 1, 1, 2, 3]


def test_annotations_reorder_only_when_complete(spark):
    groups = spark.createDataFrame([(1, "a", 1, "A"), (1, "b", 2, "B"), (2, "c", 1, "C"), (2, "d", 2, "D")], "snapshot_id long, group_id string, number int, title string")
    members = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (2, "c", "3"), (2, "d", "4")], "snapshot_id long, group_id string, change_id string")
    steps = spark.createDataFrame([(1, 1, "b", "first", "t", ["2"]), (1, 2, "a", None, "t", []), (2, 1, "d", "last", "t", []), (2, 2, "c", "bad", "t", ["4"])], "snapshot_id long, step int, group_id string, title string, transition string, change_ids array<string>")
    rows = {r.group_id: r for r in writing.annotate(groups, steps, members).collect()}
    assert (rows["b"].number, rows["b"].title, rows["b"].next_id, rows["a"].title) == (1, "first", "a", "A")
    assert (rows["c"].number, rows["c"].title, rows["d"].title) == (1, "C", "last")


def test_event_logs(spark):
    lines = ['{"type":"item.completed","item":{"type":"agent_message","text":"a"}}', '{"type":"turn","usage":{"input_tokens":5,"cached_input_tokens":9,"output_tokens":1}}', '{"type":"turn","usage":{"input_tokens":7,"cached_input_tokens":2,"output_tokens":3}}', '{"type":"item.completed","item":{"type":"command","text":"x"}}', "nonsense"]
    log = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, seq int, line string")
    (r,) = writing.decode_events(log, ["k"]).collect()
    assert (r.messages, r.usage.input_tokens, r.forbidden, r.unread) == (["a"], 7, ["command"], 1)


def test_runs_keep_their_budget(tmp_path):
    calls = []

    def send(x):
        calls.append(x)
        if x == "bad":
            raise ValueError("no")
        return x.upper()

    run = runs.Run(tmp_path / "l.json", "id")
    assert run.call("a", send, str) == "A" and runs.Run(tmp_path / "l.json", "id").call("a", send, str) == "A" and calls == ["a"]
    with pytest.raises(ValueError):
        run.call("bad", send, str)
    assert calls.count("bad") == 2
    with pytest.raises(ValueError, match="another run"):
        runs.Run(tmp_path / "l.json", "other")
    now = [time.time()]
    late = runs.Run(tmp_path / "late.json", "id", clock=lambda: now[0])
    now[0] += runs.MOST_SECONDS
    with pytest.raises(TimeoutError):
        late.call("x", send, str)
    with pytest.raises(ValueError, match="size"):
        runs.Run(tmp_path / "long.json", "id").call("x", lambda x: "x" * (runs.MOST_REPLY_BYTES + 1), str)


def test_parallel_requests_stay_within_the_budget(tmp_path):
    calls = []

    def send(x):
        calls.append(x)
        return x.upper()

    assert runs.Run(tmp_path / "p.json", "id").parallel(["x", "y", "x"], send, str) == ["X", "Y", "X"] and sorted(calls) == ["x", "y"]
    calls.clear()
    many = runs.Run(tmp_path / "many.json", "id")
    with pytest.raises(RuntimeError, match="attempt"):
        many.parallel([f"r{i}" for i in range(20)], send, str)
    assert calls == []
    # A second run on the ledger shares its budget.
    assert len(many.parallel([f"r{i}" for i in range(8)], send, str)) == 8
    with pytest.raises(RuntimeError, match="attempt"):
        runs.Run(tmp_path / "many.json", "id").parallel([f"s{i}" for i in range(5)], send, str)
    assert len(calls) == 8


def test_streams_drop_redeliveries(spark, tmp_path):
    rows = [("f1", "r", "text", "2026-01-01 00:00:00"), ("f1", "r", "text", "2026-01-02 00:00:00"), ("f2", "r", "t", "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "fragment_id string, repository string, text string, at string").select("fragment_id", "repository", "text", F.to_timestamp("at").alias("ingested_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = deliveries.first_deliveries(deliveries.read_deliveries(spark, str(tmp_path / "in"), df))
    q = stream.writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.fragment_id for r in spark.sql("select * from firsts").collect()) == ["f1", "f2"]
    for _ in range(2):
        deliveries.upsert_first(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_pages_that_do_not_add_up(spark):
    pages = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (2, 1, "c"), (3, 2, "d"), (3, 2, "d")], "k int, advertised int, item string")
    assert {r.k for r in snapshots.complete_pages(pages, "k", "advertised", "item").collect()} == {1, 3}


def test_pages_of_a_report_stand_alone():
    page = snapshots.render_html({"groups": [{"number": 1, "title": "</script>", "why_now": "x"}]}, "A & B")
    assert page.count("</script>") == 2 and "A &amp; B" in page
