import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import markup
from spanloom.operators import diff, integrity, packet
from spanloom.plans import compile as plan
from spanloom.plans import documents, runs, writing
from spanloom.sources import snapshots


@pytest.fixture(scope="module")
def demo(spark):
    t = snapshots.demo(spark)
    return t, plan.compile_snapshots(t["fragments"], t["file_evidence"], t["patches"])


def test_packets_have_their_twelve_fields(spark, demo):
    t, c = demo
    (k,) = {r.snapshot_id for r in t["fragments"].select("snapshot_id").collect()}
    meta = spark.createDataFrame([(k, "a" * 40, "b" * 40)], "snapshot_id long, base_sha string, head_sha string")
    (p,) = documents.packets(c, t["fragments"], t["file_evidence"], meta).collect()
    assert tuple(p.asDict())[1:] == documents.FIELDS and len(documents.FIELDS) == 12
    assert len(p.sources) == t["fragments"].count() and len(p.changes) == c.changes.count() and [g.group_id for g in p.groups] == [r.group_id for r in c.groups.orderBy("number").collect()]
    known = {s.source_id for s in p.sources}
    assert all(s.source_id in known for x in p.changes for s in (x.before, x.after) if s) and {x.source_id for x in p.regions} <= known
    assert diff.rebound(c.raw_files).count() == 0 and integrity.link_rules(c.groups, c.group_edges, c.test_links, c.symbols).count() == 0
    other = c.raw_files.withColumn("patch", F.lit("@@ -1 +1 @@\n-q\n+r\n"))
    assert diff.rebound(other).count() == c.raw_files.where("residual.patch_status = 'captured'").count() > 0
    assert {r.rule for r in integrity.link_rules(c.groups.limit(0), c.group_edges, c.test_links, c.symbols).collect()} == {"linked group is there"}


def test_reader_pages(spark, demo):
    _, c = demo
    (r,) = documents.reader_table(c).collect()
    report = json.loads(r.report)
    assert [g["number"] for g in report["groups"]] == list(range(1, c.groups.count() + 1)) and all(g["takeaway"] and g["changes"] for g in report["groups"])
    rows = [x for g in report["groups"] for d in g.get("diffs", []) for x in d["rows"]]
    assert {"add", "delete"} <= {x["tag"] for x in rows} and any(g.get("caveats") for g in report["groups"])
    page = snapshots.render_html(report, "Demo")
    assert page.count("</script>") == 2 and "token-keyword" in page and 'id="search"' in page and "<span class" not in page


def test_binned_intervals_meet_once(spark):
    rng = random.Random(4)
    rows = [(k, i, s, s + rng.randrange(40)) for k in (1, 2) for i in range(60) for s in [rng.randrange(-50, 300)]]
    a, b = (spark.createDataFrame(rows, f"k int, {x} int, start int, end int") for x in "ij")
    want = sorted((r.k, r.i, r.j) for r in packet.overlapping(a, b, ["k"]).collect())
    for width in (1, 16, 1000):
        assert sorted((r.k, r.i, r.j) for r in packet.overlapping(a, b, ["k"], width).collect()) == want


def test_passages_of_groups(spark):
    members = spark.createDataFrame([(1, "g", "c1"), (1, "g", "c2"), (1, "h", "c3")], "snapshot_id long, group_id string, change_id string")
    side = "struct<start:int,end:int>"
    changes = spark.createDataFrame([(1, "c1", (5, 9), (10, 20)), (1, "c2", (1, 2), None), (1, "c3", None, (1, 1))], f"snapshot_id long, change_id string, before {side}, after {side}")
    rows = [
        ("ok", "text", ["c1"], None, None, (10, 20)), ("old", "text", ["c2"], "definition", "label", (1, 2)), ("two", "text", ["c1", "c2"], "diff", None, None), ("blank", " ", ["c1"], None, None, None), ("none", "text", [], None, None, None),
        ("other", "text", ["c3"], None, None, None), ("twice", "text", ["c1", "c1"], None, None, None), ("view", "text", ["c1"], "page", None, None), ("label", "text", ["c1"], None, "x" * 161, None), ("wide", "text", ["c1"], None, None, (9, 20)), ("shown", "text", ["c1"], "diff", None, (10, 11)),
    ]
    passages = spark.createDataFrame([(1, "g", *r) for r in rows], f"snapshot_id long, group_id string, passage_id string, text string, change_ids array<string>, view string, label string, focus {side}")
    found = {(r.item, r.rule) for r in integrity.passage_rules(passages, members, changes).collect()}
    assert found == {("blank", "passage has a text"), ("none", "passage has a change"), ("other", "change of its group"), ("twice", "change once"), ("view", "view"), ("label", "label"), ("wide", "focus inside its definition"), ("shown", "focus of one definition")}


def test_what_an_editor_refers_to(spark):
    passages = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p")], "snapshot_id long, passage_id string")
    refs = spark.createDataFrame([(1, "summary", ["p", "q"]), (1, "impact", []), (1, "route", ["p", "p"]), (2, "summary", ["q"])], "snapshot_id long, field string, passage_ids array<string>")
    routes = spark.createDataFrame([(1, "mechanism"), (1, "tests"), (2, "tests"), (2, "tests")], "snapshot_id long, kind string")
    assert {(r.snapshot_id, r.rule) for r in integrity.editorial_rules(refs, passages, routes).collect()} == {
        ("1", "reference names a passage"), ("1", "reference names a passage once"), ("2", "referred passage is there"), ("2", "routes of different kinds"), ("2", "mechanism route"),
    }
    merged = spark.createDataFrame([(1, "p", "m"), (1, "q", "m"), (2, "q", "n")], "snapshot_id long, passage_id string, merged_id string")
    assert {(r.snapshot_id, r.field): r.passage_ids for r in writing.remap_references(refs.where("field = 'summary'"), merged).collect()} == {(1, "summary"): ["m"], (2, "summary"): ["n"]}


def test_walkthroughs_are_bound_to_their_packets(spark):
    packet = '{"meta":{"base_sha":"aa","head_sha":"bb"}}'
    digest = spark.range(1).select(writing.identity(F.lit(packet)).alias("d")).first().d
    usage = '{"calls":%d,"unreported_calls":0,"input_tokens":5,"cached_input_tokens":%d,"output_tokens":1}'
    good = '{"evidence_digest":"%s","base_sha":"aa","head_sha":"bb","provider":"p","model":"m","destination":"d","usage":%s}'
    packets = spark.createDataFrame([(1, packet, "aa", "bb")], "snapshot_id long, packet string, base_sha string, head_sha string")

    def written(generation):
        return spark.createDataFrame([(1, '{"sections":[]}', generation)], "snapshot_id long, story string, generation string")

    assert writing.apply_walkthrough(packets, written(good % (digest, usage % (3, 2))), "report.v2").count() == 1
    for bad in (good % ("0", usage % (3, 2)), good % (digest, usage % (13, 2)), good % (digest, usage % (3, 6)), (good % (digest, usage % (3, 2))).replace('"bb"', '"cc"'), (good % (digest, usage % (3, 2))).replace('"model":"m"', '"model":" "')):
        with pytest.raises(Exception, match="integrity"):
            writing.apply_walkthrough(packets, written(bad), "report.v2")
    reports = spark.createDataFrame([(1, '{"schema":"x","packet":{},"extra":1}', digest, "aa", "bb")], "snapshot_id long, body string, packet_digest string, base_sha string, head_sha string")
    assert {"keys of a report", "version of a report", "digest of the packet"} <= {r.rule for r in integrity.walkthrough_rules(reports, "report.v2").collect()}
    steps, meta = spark.createDataFrame([(1, "s")], "snapshot_id long, step string"), packets.select("snapshot_id", "base_sha", "head_sha")
    assert writing.bound_steps(meta, steps, meta).count() == 1
    with pytest.raises(Exception, match="other revisions"):
        writing.bound_steps(meta.withColumn("head_sha", F.lit("dd")), steps, meta).collect()


def test_answers_of_models(spark):
    def told(body):
        return spark.createDataFrame([(body,)], "b string").select(writing.decode_envelope(F.col("b")).alias("e")).first().e

    message = '{"type":"message","content":[{"type":"output_text","text":"%s"}]}'
    ok = told('{"status":"completed","output":[{"type":"reasoning"},%s,%s],"usage":{"input_tokens":5,"output_tokens":2,"input_tokens_details":{"cached_tokens":3}}}' % (message % "a", message % "b"))
    assert (ok.text, ok.usage.cached_input_tokens, ok.fault) == ("ab", 3, None)
    for body, fault in (("nonsense", "malformed"), ('{"status":"completed","status":"failed"}', "malformed"), ('{"status":"failed"}', "failed"), ('{"status":"incomplete","incomplete_details":{"reason":"max_output_tokens"}}', "max_output_tokens"), ('{"status":"completed","output":[]}', "no text"), ('{"status":"completed","output":[{"type":"message","content":[{"type":"refusal","refusal":"no"}]}]}', "refusal")):
        assert (e := told(body)).fault == fault and e.text is None, body
    over = spark.createDataFrame([("a" * 10,), ("a" * 90,)], "request string")
    assert writing.over_capacity(over, 1100, 50, 1000).count() == 1 and writing.over_capacity(over, 9000, 50, 20).count() == 1


def test_large_contents_come_from_their_blobs(spark):
    def coded(data):
        return base64.b64encode(data).decode()

    files = spark.createDataFrame([("s1", "none", 3, "", "file"), ("s2", "base64", 1, coded(b"x"), "file"), ("s3", "none", 4, "", "file"), ("s4", "none", 2, "", "file")], "sha string, encoding string, size long, content string, type string")
    blobs = spark.createDataFrame([("s1", "base64", 3, coded(b"abc")), ("s3", "base64", 3, coded(b"abc"))], "sha string, encoding string, size long, content string")
    got = {r.sha: (r.text, r.reason) for r in snapshots.decode_content(files, blobs).collect()}
    assert got == {"s1": ("abc", None), "s2": ("x", None), "s3": (None, "invalid_content_size"), "s4": (None, "unsupported_encoding")}


def test_markup_of_a_page(spark):
    terms = re.compile(r"(?<!\w)(?:load)(?!\w)")
    assert markup.inline_html("<b> `x<1` **so `y`** load reload", terms) == "&lt;b&gt; <code>x&lt;1</code> <strong>so <code>y</code></strong> <code>load</code> reload"
    assert markup.highlighted("return 'a#b' + 10 # <done>") == '<span class="token-keyword">return</span> <span class="token-string">&#x27;a#b&#x27;</span> + <span class="token-number">10</span> <span class="token-comment"># &lt;done&gt;</span>'
    rows = [("Is it whole?\n├─ yes → parse it\n└─ no → leave it",), ("a\n├─ x → y",), ("a\n├─ x → y\n├─ x → y",), ("l" * 37 + "\n├─ x → y\n└─ x → y",), (None,)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(markup.flowchart(F.col("t")).alias("f")).collect()]
    assert (got[0].label, [tuple(p) for p in got[0].paths]) == ("Is it whole?", [("yes", "parse it"), ("no", "leave it")]) and got[1:] == [None] * 4
    texts = spark.createDataFrame([("One two. Three.",), ("w" * 200 + " end.",), ("",)], "t string")
    one, two, none = (r.s for r in texts.select(markup.first_sentence(F.col("t")).alias("s")).collect())
    assert one == "One two." and len(two) == 148 and two.endswith("w…") and none is None
    (r,) = spark.createDataFrame([("a `b`",)], "t string").select(markup.inline(F.col("t"), "a").alias("i"), markup.highlight(F.col("t")).alias("h")).collect()
    assert r.i == "<code>a</code> <code>b</code>" and r.h == "a `b`"


def test_written_runs_ask_first(tmp_path):
    sent = []

    def send(x):
        sent.append(x)
        return x.upper()

    asked = []
    assert runs.narrate(tmp_path / "o.json", ["a", "b"], lambda *x: asked.append(x) or False, send, str) is None and sent == [] and asked == [(2, 2)]
    assert runs.narrate(tmp_path / "o.json", ["a", "b"], lambda *_: True, send, str, lambda r: "+".join(r)) == ["A", "B", "A+B"]
    assert runs.narrate(tmp_path / "o.json", ["a", "b"], lambda *_: True, send, str, lambda r: "+".join(r)) == ["A", "B", "A+B"] and len(sent) == 3
    assert (runs.run_seconds(1, False), runs.run_seconds(5)) == (240, 720)
