"""Planning bounded writing requests over a packet, merging what writers return, and applying annotations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import materialize, ship

#: Writers by default and at most, bytes of a packet that one writer takes whole, and of a request.
DEFAULT_WRITERS, MOST_WRITERS, SMALL_PACKET, REQUEST_BYTES, PROJECTION_BYTES = 4, 8, 80_000, 1_048_576, 24_576


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces, equal for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def strict_json(text: str) -> object:
    """Decode JSON that has no repeated key, no number beyond its range and no lone surrogate."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(name: str) -> None:
        raise ValueError(f"constant {name}")

    value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
    text_again = json.dumps(value, ensure_ascii=False, allow_nan=False)
    text_again.encode("utf-8")
    return value


def _column(kind: str, rule: Callable[[str], object]) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([None if t is None else rule(t) for t in batch], dtype="object")

        return F.pandas_udf(each, kind)(text)

    return apply


def _canonical(text: str) -> str | None:
    try:
        return canonical_json(strict_json(text))
    except (ValueError, RecursionError):
        return None


#: Canonical form of JSON text, null where it is not strict JSON; and the SHA-256 of it.
canonical = _column("string", _canonical)
identity = _column("string", lambda t: None if (c := _canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest())


def token_estimate(text: Column, vocabulary: str | None = None, overhead: int = 1024) -> Column:
    """Tokens of a text under a tiktoken file, or its bytes where none is given, and a fixed overhead."""
    if vocabulary is None:
        return F.octet_length(F.coalesce(text, F.lit(""))) + overhead

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t or "")) + overhead for t in batch], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def fits(size: Column, reserve: Column, capacity: Column) -> Column:
    """Whether a request and what is kept for its answer fit a context."""
    return size + reserve <= capacity


def pack_units(units: DataFrame, limit: int, fixed: int = 0, default: int = DEFAULT_WRITERS, most: int = MOST_WRITERS, scope: str = "snapshot_id") -> DataFrame:
    """Assign units to writers: scope, unit_id, writer (from 0, null if none can take it), load (bytes of that writer).

    units: scope, unit_id, ord, records (array of struct<id, bytes>). A writer pays for a record once, however many of its
    units share it. Larger units come first, ties in order; each goes to the least loaded writer that it fits, and a
    writer is added, up to ``most``, only when it fits none. A program of its own once a scope, all scopes side by side.
    """
    kind = units.schema[scope].dataType.simpleString()

    def each(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.unit_id, {x["id"]: int(x["bytes"]) for x in r.records}) for r in group.sort_values("ord").itertuples()]
        rows.sort(key=lambda r: -sum(r[1].values()))
        held: list[dict[str, int]] = [{} for _ in range(min(default, max(1, len(rows))))]
        place = {}
        for unit, records in rows:
            options = []
            for i, bin_ in enumerate(held):
                load = fixed + sum({**bin_, **records}.values())
                if load <= limit:
                    options.append((load, i))
            if not options and len(held) < most and fixed + sum(records.values()) <= limit:
                held.append({})
                options.append((0, len(held) - 1))
            place[unit] = min(options)[1] if options else None
            if options:
                held[place[unit]].update(records)
        return pd.DataFrame({scope: group[scope].iloc[0], "unit_id": list(place), "writer": pd.array(list(place.values()), dtype="Int32"), "load": pd.array([None if w is None else fixed + sum(held[w].values()) for w in place.values()], dtype="Int64")})

    return units.groupBy(scope).applyInPandas(each, f"{scope} {kind}, unit_id string, writer int, load long")


def split_atoms(atoms: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Cut a too large unit between atoms, in order: part (from 0) of each atom; an atom is never cut, however large.

    atoms: keys, ord, bytes.
    """
    schema = ", ".join(f"{k} {atoms.schema[k].dataType.simpleString()}" for k in keys)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        part, held, out = 0, 0, []
        for n in (ordered := group.sort_values("ord"))["bytes"]:
            if held and held + n > limit:
                part, held = part + 1, 0
            held += n
            out.append(part)
        return ordered[[*keys, "ord"]].assign(part=out)

    return atoms.groupBy(*keys).applyInPandas(each, f"{schema}, ord {atoms.schema['ord'].dataType.simpleString()}, part int")


def requests(placed: DataFrame, contents: DataFrame, scope: str = "snapshot_id") -> DataFrame:
    """One request a writer: its units' contents in order as canonical JSON, with key and size. contents: scope, unit_id, ord, body (JSON)."""
    ship(placed.sparkSession)
    joined = placed.where("writer is not null").join(contents, [scope, "unit_id"])
    bodies = joined.groupBy(scope, "writer").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]).alias("bodies"))
    text = canonical(F.concat(F.lit("["), F.array_join("bodies", ","), F.lit("]")))
    return bodies.select(scope, "writer", text.alias("request")).withColumns({"request_key": F.sha2("request", 256), "request_bytes": F.octet_length("request")})


def merge_passages(passages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Passages merged by their editor: change, region and citation lists united in order. mapping: snapshot_id, passage_id, merged_id, ord."""
    joined = passages.join(mapping, ["snapshot_id", "passage_id"])
    parts = joined.groupBy("snapshot_id", "merged_id").agg(F.sort_array(F.collect_list(F.struct("ord", "change_ids", "region_ids", "citations"))).alias("p"))

    def united(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform("p", lambda x: x[name])))

    return parts.select("snapshot_id", "merged_id", *[united(n).alias(n) for n in ("change_ids", "region_ids", "citations")])


def default_passages(changes: DataFrame) -> DataFrame:
    """One passage a change where none was written."""
    return changes.select("snapshot_id", "group_id", F.col("change_id").alias("passage_id"), F.col("label").alias("title"), F.array("change_id").alias("change_ids"))


def annotate(groups: DataFrame, steps: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with the titles and texts that steps give them, in the steps' order if they name every group of the snapshot.

    steps: snapshot_id, step, group_id, title, transition, change_ids. A step whose changes are not all of its group is not applied.
    """
    own = members.groupBy("snapshot_id", "group_id").agg(F.collect_set("change_id").alias("own"))
    good = steps.join(own, ["snapshot_id", "group_id"]).where(F.size(F.array_except(F.coalesce("change_ids", F.array().cast("array<string>")), "own")) == 0)
    good = good.select("snapshot_id", "group_id", "step", F.col("title").alias("new_title"), "transition")
    joined = groups.join(good, ["snapshot_id", "group_id"], "left")
    whole = Window.partitionBy("snapshot_id")
    complete = F.count("*").over(whole) == F.count("step").over(whole)
    placed = joined.withColumn("_at", F.when(complete, F.col("step")).otherwise(F.col("number")))
    along = Window.partitionBy("snapshot_id").orderBy("_at", "number")
    return placed.withColumns({"title": F.coalesce("new_title", "title"), "number": F.row_number().over(along), "next_id": F.lead("group_id").over(along)}).drop("_at", "step", "new_title")


def usage_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Token use by key: sums over calls that reported it, and how many did not. events: keys, input_tokens, cached_tokens, output_tokens."""
    told = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return events.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(~told).alias("unreported"),
        *[F.coalesce(F.sum(F.when(told, F.col(c))), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")],
    )


def decode_events(log: DataFrame, keys: list[str], by: str = "seq", line: str = "line") -> DataFrame:
    """A finished log of JSON events: final messages in order, the last valid usage, and the kinds that are not allowed."""
    # Strict first: a line with a name twice, or of no JSON, is unread.
    event = F.from_json(canonical(F.col(line)), "type string, item struct<type:string,text:string>, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>")
    ship(log.sparkSession)
    read = log.withColumn("_e", event)
    message = F.when((F.col("_e.type") == "item.completed") & (F.col("_e.item.type") == "agent_message"), F.struct(by, F.col("_e.item.text").alias("text")))
    valid = F.col("_e.usage.input_tokens").isNotNull() & (F.col("_e.usage.input_tokens") >= 0) & (F.coalesce("_e.usage.cached_input_tokens", F.lit(0)) <= F.col("_e.usage.input_tokens"))
    other = F.when(F.col("_e.item.type").isNotNull() & ~F.col("_e.item.type").isin("agent_message", "reasoning"), F.col("_e.item.type"))
    return read.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(message)), lambda x: x["text"]).alias("messages"),
        F.max_by(F.when(valid, F.col("_e.usage")), F.when(valid, F.col(by))).alias("usage"), F.sort_array(F.collect_set(other)).alias("forbidden"), F.count_if(F.col("_e").isNull() | F.col("_e.type").isNull()).alias("unread"),
    )


def decode_envelope(body: Column) -> Column:
    """struct<text, usage, fault> of a model's answer: its texts in order, the tokens it reports if they add up, and why it is none."""
    r = F.from_json(canonical(body), "status string, incomplete_details struct<reason:string>, output array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>, usage struct<input_tokens:bigint,output_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint>>")
    none = F.array().cast("array<struct<type:string,text:string,refusal:string>>")
    parts = F.flatten(F.transform(F.filter(F.coalesce(r["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>")), lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], none)))
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    cached = F.coalesce(r["usage"]["input_tokens_details"]["cached_tokens"], F.lit(0))
    told = (r["usage"]["input_tokens"] >= 0) & (r["usage"]["output_tokens"] >= 0) & (cached >= 0) & (cached <= r["usage"]["input_tokens"])
    fault = (
        F.when(r.isNull() | r["status"].isNull(), "malformed").when(r["status"] == "incomplete", F.coalesce(r["incomplete_details"]["reason"], F.lit("incomplete"))).when(r["status"] != "completed", "failed")
        .when(F.exists(parts, lambda p: p["type"] == "refusal"), "refusal").when(text == "", "no text")
    )
    usage = F.when(told, F.struct(r["usage"]["input_tokens"].alias("input_tokens"), cached.alias("cached_input_tokens"), r["usage"]["output_tokens"].alias("output_tokens")))
    return F.struct(F.when(fault.isNull(), text).alias("text"), usage.alias("usage"), fault.alias("fault"))


def remap_references(references: DataFrame, mapping: DataFrame) -> DataFrame:
    """References whose passages were merged: their passage_ids by the merged ones, in order, each once. mapping: snapshot_id, passage_id, merged_id."""
    flat = references.select("snapshot_id", "field", F.posexplode("passage_ids").alias("at", "passage_id")).join(mapping.select("snapshot_id", "passage_id", "merged_id"), ["snapshot_id", "passage_id"], "left")
    new = F.coalesce("merged_id", "passage_id")
    return flat.groupBy("snapshot_id", "field").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", new.alias("id")))), lambda x: x["id"])).alias("passage_ids"))


def bound_steps(documents: DataFrame, steps: DataFrame, meta: DataFrame) -> DataFrame:
    """The steps of annotation documents of the revisions that were compiled; one of other revisions fails the job.

    documents: snapshot_id, base_sha, head_sha; meta likewise.
    """
    pinned = meta.select("snapshot_id", F.col("base_sha").alias("_b"), F.col("head_sha").alias("_h"))
    same = F.col("base_sha").eqNullSafe(F.col("_b")) & F.col("head_sha").eqNullSafe(F.col("_h"))
    checked = documents.join(pinned, "snapshot_id", "left").where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("annotations of other revisions: "), F.col("snapshot_id").cast("string"))).cast("boolean")))
    return steps.join(checked.select("snapshot_id"), "snapshot_id")


def apply_walkthrough(packets: DataFrame, annotations: DataFrame, version: str) -> DataFrame:
    """snapshot_id and body of the reports that packets and written annotations make, after the rules of such reports; a broken one fails the job.

    packets: snapshot_id, packet (JSON), base_sha, head_sha; annotations: snapshot_id, story and generation (JSON).
    """
    from spanloom.operators import integrity

    body = F.concat(F.lit('{"schema":'), F.to_json(F.array(F.lit(version))).substr(F.lit(2), F.lit(len(version) + 2)), F.lit(',"packet":'), "packet", F.lit(',"story":'), "story", F.lit(',"generation":'), "generation", F.lit("}"))
    made = materialize(packets.join(annotations, "snapshot_id").select("snapshot_id", body.alias("body"), identity(F.col("packet")).alias("packet_digest"), "base_sha", "head_sha"), "walkthrough")
    integrity.enforce(integrity.walkthrough_rules(made, version)).collect()
    return made.select("snapshot_id", "body")


def over_capacity(requests_: DataFrame, capacity: int, reserve: int, most_bytes: int, vocabulary: str | None = None) -> DataFrame:
    """Requests that cannot be sent: beyond ``most_bytes``, or whose estimate and reserve for the answer exceed the context."""
    sized = requests_.withColumn("estimate", token_estimate(F.col("request"), vocabulary))
    return sized.where((F.octet_length("request") > most_bytes) | ~fits(F.col("estimate"), F.lit(reserve), F.lit(capacity)))


def cached_results(requests_: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their stored results, where the stored digest still holds. cache: request_key, result, result_digest."""
    sound = cache.where(F.sha2("result", 256) == F.col("result_digest")).dropDuplicates(["request_key"])
    return requests_.join(sound.select("request_key", "result"), "request_key", "left").withColumn("cached", F.col("result").isNotNull())
