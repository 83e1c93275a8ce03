"""Reading and writing snapshots, reports and their files."""

from __future__ import annotations

import base64
import difflib
import hashlib
import json
import subprocess
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanloom import schemas
from spanloom.functions import markup
from spanloom.functions import text as X
from spanloom.session import materialize

REASONS = ("not_supplied", "size_limit", "binary_or_non_utf8", "unsupported_object", "invalid_content_size", "unsupported_encoding", "read_failed")
MAX_FILES, MAX_SNAPSHOT_BYTES, GIT_SECONDS = 500, 64_000_000, 90


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents, one a file, with a stable snapshot_id; a document that is not of the schema fails the read."""
    raw = spark.read.schema(schemas.SNAPSHOT_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.withColumn("snapshot_id", F.xxhash64("schema", "meta.base_sha", "meta.head_sha", "meta.repository", F.input_file_name()))


def snapshot_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of snapshot documents: meta, fragments, file_evidence, patches."""
    fragment = documents.select("snapshot_id", F.col("meta.repository").alias("repository"), F.posexplode("fragments").alias("idx", "f")).select("snapshot_id", "repository", "idx", "f.*")
    return {
        "meta": documents.select("snapshot_id", F.col("schema").alias("schema_tag"), "meta.*"),
        "fragments": fragment.withColumns({"start_line": F.coalesce("start_line", F.lit(1)), "fragment_id": X.stable_id(F.col("side"), F.col("path"), F.coalesce("start_line", F.lit(1)), F.col("idx")), "ingested_at": F.lit(None).cast("timestamp")}),
        "file_evidence": documents.select("snapshot_id", F.posexplode("file_evidence").alias("rec_idx", "e")).select("snapshot_id", "rec_idx", "e.*"),
        "patches": documents.select("snapshot_id", F.explode("patches").alias("p")).select("snapshot_id", "p.*"),
    }


def snapshot_documents(meta: DataFrame, fragments: DataFrame, evidence: DataFrame, patches: DataFrame) -> DataFrame:
    """Snapshot documents from their tables, records in order: the inverse of ``snapshot_tables``."""
    parts = (
        fragments.groupBy("snapshot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.struct("path", "side", "text", "start_line", "scope", "region", "syntax").alias("f")))), lambda x: x["f"]).alias("fragments")),
        evidence.groupBy("snapshot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rec_idx", F.struct("base", "head").alias("e")))), lambda x: x["e"]).alias("file_evidence")),
        patches.groupBy("snapshot_id").agg(F.sort_array(F.collect_list(F.struct("path", "origin", "patch"))).alias("patches")),
    )
    fields = [c for c in ("base_sha", "head_sha", "scope", "repository", "head_repository", "changed_files", "title", "description", "source_bytes") if c in meta.columns]
    out = meta.select("snapshot_id", F.col("schema_tag").alias("schema"), F.struct(*fields).alias("meta"))
    for p in parts:
        out = out.join(p, "snapshot_id", "left")
    return out


def write_json(documents: DataFrame, path: str, most_bytes: int = 256_000_000) -> None:
    """Write one JSON line a document; any that exceeds ``most_bytes`` fails the write before it is committed."""
    line = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"})
    checked = F.when(F.octet_length(line) <= most_bytes, line).otherwise(F.raise_error(F.lit("a document exceeds its size")).cast("string"))
    documents.select(checked.alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write several tables and, last, a manifest of them: the manifest's presence says that all of them are whole.

    Each writing has its own folder below ``folder``, and the manifest names it, so that readers never see tables of two
    writings. Rows are counted while they are written.
    """
    spark = next(iter(tables.values())).sparkSession
    version, rows = uuid.uuid4().hex, []
    for name, df in tables.items():
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{version}/{name}")
        rows.append((name, version, counted.get["n"]))
    manifest = spark.createDataFrame(rows, "name string, version string, n_rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: path (relative), size, digest, content."""
    base = Path(folder).resolve().as_uri()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.ltrim(F.replace(F.regexp_replace("path", "^file:/+", "file:///"), F.lit(base), F.lit("")), F.lit("/"))
    return raw.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), "content")


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Entries that differ between a manifest and what is there: path, fault (missing, unlisted or changed)."""
    a = listed.select("path", F.col("digest").alias("want"))
    b = found.select("path", F.col("digest").alias("have"))
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("want").eqNullSafe(F.col("have"))).select("path", fault.alias("fault"))


def forbidden_files(found: DataFrame, allowed: list[str]) -> DataFrame:
    """Files that no allowed pattern names, or whose name or text looks like a credential."""
    named = F.lit(False)
    for rule in allowed:
        named = named | F.col("path").rlike(rule)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    text = F.when(X.is_text(F.col("content")), F.col("content").cast("string")).otherwise("")
    rules = [
        (~named, "name"), (name.rlike(r"^(\.env.*|.*\.(pem|key|p12|pfx)|id_rsa.*|credentials.*|\.netrc)$"), "credential file"),
        (text.rlike(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"), "credential"),
        (name.endswith(".png") & (F.hex(F.substring("content", 1, 8)) != "89504E470D0A1A0A"), "signature"),
    ]
    faults = F.filter(F.array(*[F.when(test, F.lit(fault)) for test, fault in rules]), lambda x: x.isNotNull())
    return found.select("path", faults.alias("faults")).where(F.size("faults") > 0)


def decode_content(files_: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Contents of a code host's file records: text, or the reason why there is none. Columns encoding, size, content, type.

    A record too large for its content (encoding none) takes it from its blob, by ``sha``, where ``blobs`` (sha, encoding,
    size, content) are given; the sizes that both declare must agree.
    """
    if blobs is not None:
        large = F.col("encoding") == "none"
        b = blobs.select("sha", F.col("encoding").alias("_encoding"), F.col("size").alias("_size"), F.col("content").alias("_content")).dropDuplicates(["sha"])
        files_ = files_.join(b, "sha", "left").withColumns({
            "size": F.when(large & (F.col("_size") != F.col("size")), F.lit(-1)).otherwise(F.col("size")), "content": F.when(large, F.col("_content")).otherwise(F.col("content")), "encoding": F.when(large, F.coalesce("_encoding", "encoding")).otherwise(F.col("encoding")),
        }).drop("_encoding", "_size", "_content")
    data = F.when(F.col("encoding") == "base64", F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64")))
    reason = (
        F.when(F.col("type") != "file", "unsupported_object")
        .when(F.col("size").isNull() | (F.col("size") < 0), "invalid_content_size")
        .when(F.col("size") > X.MAX_SOURCE_BYTES, "size_limit")
        .when(F.col("encoding") != "base64", "unsupported_encoding")
        .when(F.col("_data").isNull(), "read_failed")
        .when(F.octet_length("_data") != F.col("size"), "invalid_content_size")
        .when(~X.is_text(F.col("_data")), "binary_or_non_utf8")
    )
    out = files_.withColumn("_data", data).withColumn("reason", reason)
    return out.withColumn("text", F.when(F.col("reason").isNull(), F.col("_data").cast("string"))).drop("_data")


def complete_pages(pages: DataFrame, key: str, advertised: str, item: str) -> DataFrame:
    """Listings whose pages do not add up to the advertised number of items: key, advertised, found, distinct_items."""
    counted = pages.groupBy(key).agg(F.max(advertised).alias("advertised"), F.count(item).alias("found"), F.countDistinct(item).alias("distinct_items"))
    return counted.where("found <> advertised or distinct_items <> found")


def _git(repository: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *args], check=True, capture_output=True, timeout=GIT_SECONDS).stdout


PLAIN = ("100644", "100755")


def _git_sizes(repository: str, objects: list[str]) -> dict[str, int]:
    """Bytes of each object, before any is read."""
    wanted = sorted(set(objects) - {"0" * 40})
    told = subprocess.run(["git", "-C", repository, "cat-file", "--batch-check=%(objectname) %(objectsize)"], input="\n".join(wanted).encode(), check=True, capture_output=True, timeout=GIT_SECONDS).stdout.decode()
    return {oid: int(n) for oid, n in (line.split(" ") for line in told.splitlines())}


def _text(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 without NUL."""
    try:
        return data.decode("utf-8") if b"\0" not in data else None
    except UnicodeDecodeError:
        return None


def read_git(spark: SparkSession, repository: str, base: str, head: str, two_dot: bool = False, include_tests: bool = False, most_files: int = MAX_FILES, most_bytes: int = MAX_SNAPSHOT_BYTES) -> dict[str, DataFrame]:
    """The tables of one snapshot of a local repository: listing on the driver, contents read by tasks in chunks of paths.

    Renames appear as a removal and an addition. A side that is too large or is no text is unavailable, with its reason
    and a warning; a patch is captured, as it is, only where both sides can be read. Only commits are read, never the
    working tree. Sources or patches beyond ``most_bytes`` in all fail the read.
    """
    base_sha, head_sha = (_git(repository, "rev-parse", "--verify", f"{r}^{{commit}}").decode().strip() for r in (base, head))
    if not two_dot:
        base_sha = _git(repository, "merge-base", base_sha, head_sha).decode().strip()
    listing = _git(repository, "diff", "--no-renames", "--raw", "-z", "--abbrev=40", base_sha, head_sha).decode("utf-8", "surrogateescape").split("\0")
    rows = []
    for info, path in zip(listing[::2], listing[1::2]):
        old_mode, new_mode, old, new, _ = info.lstrip(":").split(" ")
        rows.append((len(rows), path, old_mode, new_mode, old, new))
    if len(rows) > most_files:
        raise ValueError("too many changed files")
    sizes = _git_sizes(repository, [oid for r in rows for mode, oid in ((r[2], r[4]), (r[3], r[5])) if mode in PLAIN])
    if sum(n for n in sizes.values() if n <= X.MAX_SOURCE_BYTES) > most_bytes:
        raise ValueError("the sources exceed their bytes")
    listed = spark.createDataFrame(rows, "rec_idx int, path string, old_mode string, new_mode string, old string, new string")
    if not include_tests:
        listed = listed.where(~X.is_test_path(F.col("path")))

    def read(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                sides, texts = {}, {}
                for side, mode, oid in (("base", r.old_mode, r.old), ("head", r.new_mode, r.new)):
                    state, reason, text = "supplied", None, None
                    if set(oid) == {"0"}:
                        state = "absent"
                    elif mode not in PLAIN:
                        state, reason = "unavailable", "unsupported_object"
                    elif sizes[oid] > X.MAX_SOURCE_BYTES:
                        state, reason = "unavailable", "size_limit"
                    else:
                        text = _text(_git(repository, "cat-file", "blob", oid))
                        if text is None:
                            state, reason = "unavailable", "binary_or_non_utf8"
                    sides[side] = {"path": r.path, "state": state, "coverage": "full" if state == "supplied" else None, "reason": reason}
                    texts[side] = text
                patch = None
                if all(s["state"] != "unavailable" for s in sides.values()):
                    patch = _git(repository, "diff", "--no-renames", "--no-color", "--no-ext-diff", "--no-textconv", base_sha, head_sha, "--", r.path).decode("utf-8")
                out.append((r.rec_idx, r.path, sides["base"], sides["head"], texts["base"], texts["head"], patch))
            import pandas as pd

            yield pd.DataFrame(out, columns=["rec_idx", "path", "base", "head", "base_text", "head_text", "patch"])

    raw = listed.repartition(4).mapInPandas(read, f"rec_idx int, path string, base {schemas.SIDE}, head {schemas.SIDE}, base_text string, head_text string, patch string")
    raw = materialize(raw, "git-files")
    if (raw.agg(F.sum(F.octet_length("patch"))).first()[0] or 0) > most_bytes:
        raise ValueError("the patches exceed their bytes")
    snapshot = F.lit(int(hashlib.sha256(f"{base_sha}{head_sha}".encode()).hexdigest()[:15], 16)).cast("long").alias("snapshot_id")
    sides = raw.select(snapshot, "rec_idx", "path", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base_text").alias("text")), F.struct(F.lit("head").alias("side"), F.col("head_text").alias("text")))).alias("s")).where("s.text is not null")
    idx = F.col("rec_idx") * 2 + F.when(F.col("s.side") == "head", 1).otherwise(0)
    fragments = sides.select("snapshot_id", idx.alias("idx"), F.lit(None).cast("string").alias("repository"), "s.side", "path", "s.text", F.lit(1).alias("start_line"), F.lit("full").alias("scope"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("syntax"), F.lit(None).cast("timestamp").alias("ingested_at"))
    meta = spark.range(1).select(snapshot, F.lit(base_sha).alias("base_sha"), F.lit(head_sha).alias("head_sha"), F.lit("full").alias("scope"), F.lit(None).cast("string").alias("repository"), F.lit(len(rows)).alias("changed_files"), F.lit(sum(n for n in sizes.values() if n <= X.MAX_SOURCE_BYTES)).cast("long").alias("source_bytes"))
    side = F.struct(F.lit("base").alias("side"), F.col("base.reason").alias("reason")), F.struct(F.lit("head").alias("side"), F.col("head.reason").alias("reason"))
    skipped = raw.select(snapshot, "rec_idx", "path", F.posexplode(F.array(*side)).alias("ord", "s")).where("s.reason is not null")
    skipped = skipped.select("snapshot_id", (F.col("rec_idx") * 2 + F.col("ord")).alias("ord"), F.concat(F.lit("Skipped "), "s.side", F.lit(" "), "path", F.lit(": "), "s.reason").alias("warning"))
    return {
        "meta": meta,
        "fragments": fragments.withColumn("fragment_id", X.stable_id(F.col("side"), F.col("path"), F.col("start_line"), F.col("idx"))),
        "file_evidence": raw.select(snapshot, "rec_idx", "base", "head"),
        "patches": raw.select(snapshot, "path", F.lit("git").alias("origin"), "patch"),
        "warnings": skipped,
    }


def synthetic(spark: SparkSession, n_files: int = 32, n_lines: int = 1200, snapshot_id: int = 0) -> dict[str, DataFrame]:
    """A snapshot of generated files, each with its last line edited; at most 128 files of 4,000 lines."""
    if not (1 <= n_files <= 128 and 1 <= n_lines <= 4000):
        raise ValueError("size of the synthetic snapshot")
    numbers = spark.range(n_files).select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.col("id").cast("int").alias("rec_idx"), F.format_string("src/module_%03d.py", F.col("id")).alias("path"))
    line = lambda last: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_lines)), lambda i: F.concat(F.lit("value_"), i.cast("string"), F.lit(" = "), F.when(i == n_lines, F.lit(last)).otherwise(i).cast("string"))), "\n")
    texts = numbers.withColumns({"base_text": F.concat(line(0), F.lit("\n")), "head_text": F.concat(line(-1), F.lit("\n"))})
    side = F.struct("path", F.lit("supplied").alias("state"), F.lit("full").alias("coverage"), F.lit(None).cast("string").alias("reason"))
    parts = texts.select("snapshot_id", "rec_idx", "path", F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base_text").alias("text")), F.struct(F.lit("head").alias("side"), F.col("head_text").alias("text")))).alias("s"))
    idx = F.col("rec_idx") * 2 + F.when(F.col("s.side") == "head", 1).otherwise(0)
    fragments = parts.select("snapshot_id", idx.alias("idx"), F.lit(None).cast("string").alias("repository"), "s.side", "path", "s.text", F.lit(1).alias("start_line"), F.lit("full").alias("scope"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("syntax"), F.lit(None).cast("timestamp").alias("ingested_at"))
    n = str(n_lines)
    context = F.array_join(F.transform(F.sequence(F.lit(max(1, n_lines - 3)), F.lit(max(1, n_lines - 1))), lambda i: F.concat(F.lit(" value_"), i.cast("string"), F.lit(" = "), i.cast("string"))), "\n") if n_lines > 1 else F.lit("")
    first, count = max(1, n_lines - 3), min(4, n_lines)
    patch = F.concat_ws("\n", F.lit(f"@@ -{first},{count} +{first},{count} @@"), *([context] if n_lines > 1 else []), F.lit(f"-value_{n} = 0"), F.lit(f"+value_{n} = -1"), F.lit(""))
    return {
        "meta": spark.range(1).select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.lit("a" * 40).alias("base_sha"), F.lit("b" * 40).alias("head_sha"), F.lit(n_files).alias("changed_files")),
        "fragments": fragments.withColumn("fragment_id", X.stable_id(F.col("side"), F.col("path"), F.col("start_line"), F.col("idx"))),
        "file_evidence": numbers.select("snapshot_id", "rec_idx", side.alias("base"), side.alias("head")),
        "patches": numbers.select("snapshot_id", "path", F.lit("git").alias("origin"), patch.alias("patch")),
    }


def from_files(spark: SparkSession, before: dict[str, str], after: dict[str, str], snapshot_id: int = 1) -> dict[str, DataFrame]:
    """The tables of a small snapshot given as two file trees, with patches of their differences."""
    fragments, records, patches = [], [], []
    for i, path in enumerate(sorted({*before, *after})):
        sides = {}
        for side, tree in (("base", before), ("head", after)):
            there = path in tree
            sides[side] = (path, "supplied" if there else "absent", "full" if there else None, None)
            if there:
                fid = hashlib.sha256("\0".join((side, path, "1", str(len(fragments)))).encode()).hexdigest()[:16]
                fragments.append((snapshot_id, fid, len(fragments), None, side, path, tree[path], 1, "full", None, None, None))
        records.append((snapshot_id, i, sides["base"], sides["head"]))
        lines = []
        old, new = ([x for x in _keep(t.get(path, ""))] for t in (before, after))
        for x in list(difflib.unified_diff(old, new, lineterm="\n"))[2:]:
            lines.append(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n")
        patches.append((snapshot_id, path, "git", "".join(lines)))
    return {
        "fragments": spark.createDataFrame(fragments, "snapshot_id long, fragment_id string, idx int, repository string, side string, path string, text string, start_line int, scope string, region string, syntax string, ingested_at timestamp"),
        "file_evidence": spark.createDataFrame(records, f"snapshot_id long, rec_idx int, base {schemas.SIDE}, head {schemas.SIDE}"),
        "patches": spark.createDataFrame(patches, "snapshot_id long, path string, origin string, patch string"),
    }


def _keep(text: str) -> list[str]:
    from spanloom.operators.extract import split_lines

    return split_lines(text, True)


def recorded_pull(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of pull requests from recorded answers of a code host: files with contents in base64 and patches, one JSON a pull request.

    Fields: base_sha, head_sha, repository, changed_files, head_again (the head when it was read once more) and files of
    (filename, previous_filename, status, patch, base, head), the last two being content records. A moved head, or
    a listing that is not complete, fails the read.
    """
    content = "struct<type:string,encoding:string,size:bigint,content:string>"
    schema = f"base_sha string, head_sha string, head_again string, repository string, changed_files int, files array<struct<filename:string,previous_filename:string,status:string,patch:string,base:{content},head:{content}>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    moved = F.when((F.coalesce("head_again", "head_sha") != F.col("head_sha")) | (F.size("files") != F.col("changed_files")), F.raise_error(F.lit("the pull request moved or its file list is not complete")).cast("long"))
    pulls = raw.withColumn("snapshot_id", F.coalesce(moved, F.xxhash64("repository", "base_sha", "head_sha")))
    flat = pulls.select("snapshot_id", "repository", F.posexplode("files").alias("rec_idx", "f")).select("snapshot_id", "repository", "rec_idx", "f.*")
    sided = flat.select("snapshot_id", "repository", "rec_idx", F.col("filename").alias("head_path"), F.coalesce("previous_filename", "filename").alias("base_path"), F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base").alias("c")), F.struct(F.lit("head").alias("side"), F.col("head").alias("c")))).alias("s"), "status")
    read = decode_content(sided.select("snapshot_id", "repository", "rec_idx", "head_path", "base_path", "s.side", "s.c.*", F.col("s.c").isNull().alias("none")))
    state = F.when(F.col("none"), "absent").when(F.col("reason").isNotNull(), "unavailable").otherwise("supplied")
    path_ = F.when(F.col("side") == "base", F.col("base_path")).otherwise(F.col("head_path"))
    told = read.withColumns({"state": state, "path": path_})
    side = F.struct("path", "state", F.when(F.col("state") == "supplied", "full").alias("coverage"), F.when(F.col("state") == "unavailable", F.col("reason")).alias("reason"))
    evidence = told.groupBy("snapshot_id", "rec_idx").agg(F.max(F.when(F.col("side") == "base", side)).alias("base"), F.max(F.when(F.col("side") == "head", side)).alias("head"))
    idx = F.col("rec_idx") * 2 + F.when(F.col("side") == "head", 1).otherwise(0)
    fragments = told.where("state = 'supplied'").select("snapshot_id", idx.alias("idx"), "repository", "side", "path", "text", F.lit(1).alias("start_line"), F.lit("full").alias("scope"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("syntax"), F.lit(None).cast("timestamp").alias("ingested_at"))
    return {
        "meta": pulls.select("snapshot_id", "base_sha", "head_sha", "repository", "changed_files"),
        "fragments": fragments.withColumn("fragment_id", X.stable_id(F.col("side"), F.col("path"), F.col("start_line"), F.col("idx"))),
        "file_evidence": evidence,
        "patches": flat.select("snapshot_id", F.col("filename").alias("path"), F.lit("github").alias("origin"), "patch"),
    }


def encode_content(text: str) -> dict:
    """A content record as a code host gives it."""
    data = text.encode()
    return {"type": "file", "encoding": "base64", "size": len(data), "content": base64.b64encode(data).decode()}


#: The page's own code: everything comes from the data as text, and nothing is ever read as markup but what was escaped here.
_PAGE = """
const report=JSON.parse(document.getElementById('data').textContent),list=document.getElementById('groups'),box=document.getElementById('search');
function add(parent,name,text,kind){const e=document.createElement(name);if(text!==undefined&&text!==null)e.textContent=text;if(kind)e.className=kind;parent.append(e);return e}
function flat(x){return String(x||'').toLowerCase().replace(/\\s+/g,' ')}
for(const g of report.groups){const s=add(list,'li',null,'group');add(s,'h2',g.number+'. '+g.title);add(s,'p',g.why_now);
 for(const key of ['intent','before','after','takeaway'])if(g[key])add(s,'p',g[key],key);
 for(const q of [...(g.invariants||[]),...(g.questions||[])])add(s,'p',q,'check');
 for(const c of g.changes||[]){const d=add(s,'details',null,'change');add(d,'summary',c.label+' · '+(c.name||''));add(d,'p',c.basis)}
 for(const d of g.diffs||[]){add(s,'h3',d.path);const t=add(s,'pre',null,'diff');for(const r of d.rows){const l=add(t,'div',null,r.tag);add(l,'span',(r.old??'')+' '+(r.new??''),'number');l.append(document.createRange().createContextualFragment(r.html))}}
 for(const w of g.caveats||[])add(s,'p',w,'caveat');s.dataset.text=flat(s.textContent)}
for(const w of report.warnings||[])add(document.getElementById('warnings'),'p',w);
box.addEventListener('input',()=>{const q=flat(box.value).trim();for(const s of list.children)s.hidden=q!==''&&!s.dataset.text.includes(q)});
"""


def render_html(report: dict, title: str) -> str:
    """One report as a page that stands alone: groups with their narrative, changes, differences and caveats, and a search.

    Its data lie in a script element and are escaped for it; rows of differences (tag, old, new, text) get their
    highlighted ``html`` here, all other texts are set as texts by the page.
    """
    shown = json.loads(json.dumps(report))
    for group in shown.get("groups", ()):
        for shown_diff in group.get("diffs", ()):
            for row in shown_diff["rows"]:
                row["html"] = markup.highlighted(row.pop("text"))
    data = json.dumps(shown, ensure_ascii=False)
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        data = data.replace(a, b)
    name = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = f'<h1>{name}</h1><div id="warnings"></div><input id="search" type="search"><ol id="groups"></ol>'
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{name}</title>{body}<script type="application/json" id="data">{data}</script><script>{_PAGE}</script></html>'


def read_reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that ``write_tables`` wrote, once their manifest says that they are whole and their rows are all there."""
    manifest = {r["name"]: r for r in spark.read.schema("name string, version string, n_rows long").json(f"{folder}/manifest").collect()}
    out = {name: spark.read.parquet(f"{folder}/{r['version']}/{name}") for name, r in manifest.items()}
    for name, df in out.items():
        if df.count() != manifest[name]["n_rows"]:
            raise ValueError(f"table {name} is not whole")
    return out


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Steps of annotation documents, one JSON a snapshot: snapshot_id, step (from 1), group_id, title, transition, change_ids."""
    schema = "snapshot_id bigint, steps array<struct<group_id:string,title:string,transition:string,change_ids:array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("snapshot_id", F.posexplode("steps").alias("i", "s")).select("snapshot_id", (F.col("i") + 1).alias("step"), "s.*")


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """A small snapshot with a move, a rename, an edit, new tests and notes."""
    one = "def {0}(value):\n    step = value + {1}\n    return step * 2\n"
    before = {"app/core.py": "import math\n\n\n" + one.format("load", 1) + "\n\n" + one.format("_trim", 2), "app/extra.py": one.format("merge_rows", 3), "NOTES.md": "First\nSecond\n"}
    after = {
        "app/core.py": "import math\nimport sys\n\n\n" + one.format("load", 7), "app/text.py": one.format("trim", 2), "app/rows.py": one.format("merge_rows", 3),
        "tests/test_core.py": "from app.core import load\n\n\ndef test_load():\n    assert load(1)\n", "NOTES.md": "First\n2nd\n",
    }
    return from_files(spark, before, after)
