"""Raw records to event rows: decode, normalise, authenticate, drop duplicates.

Every record or item that is not stored leaves one row with a reason.
Names of fields are matched in any case; an event that has one twice is malformed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grouping import fingerprint
from ..functions.text import first_non_empty, join_non_empty, let, parse_event_time, present, truncate_bytes
from ..schema import EXCEPTIONS, ITEM, SCHEMA_VERSION

MAX_BYTES = 20 << 20
MAX_ITEMS = 50
MAX_ITEM_BYTES = 10 << 20
TITLE_BYTES = 200
ENVELOPE, SINGLE = 1, 2
ITEM_TYPES = ("event", "transaction", "attachment", "session", "client_report", "check_in")
EVENT_TYPES = ("event", "transaction")


class Rejected(Exception):
    """A record that cannot be stored; the argument is one of schema.REASONS."""


def inflate(body: bytes, encoding: str, limit: int = MAX_BYTES) -> bytes:
    """The plain body; it is never inflated much beyond ``limit`` bytes."""
    if len(body) > limit:
        raise Rejected("too_large")
    encoding = encoding.lower()
    try:
        if encoding in ("", "identity"):
            return body
        if encoding in ("gzip", "deflate"):
            out = b""
            while body:
                one = zlib.decompressobj(31 if encoding == "gzip" else 15)
                out += one.decompress(body, limit + 1 - len(out))
                if len(out) > limit:
                    raise Rejected("too_large")
                if not one.eof:
                    raise Rejected("malformed")
                body = one.unused_data if encoding == "gzip" else b""
            return out
        if encoding == "zstd":
            with pa.CompressedInputStream(pa.BufferReader(body), "zstd") as stream:
                out = stream.read(limit + 1)
            if len(out) > limit:
                raise Rejected("too_large")
            return out
    except (zlib.error, OSError):
        pass
    raise Rejected("malformed")


def _header(line: bytes, fields: dict[str, type]) -> dict:
    """A JSON object whose named fields have the given types, or are null or missing."""
    try:
        found = json.loads(line)
    except (ValueError, RecursionError):
        raise Rejected("malformed") from None
    found = {} if found is None else found
    if isinstance(found, dict):
        found = {k.lower(): v for k, v in found.items()}  # the last of a name counts
    if not isinstance(found, dict) or any(found.get(k) is not None and type(found[k]) is not t for k, t in fields.items()):
        raise Rejected("malformed")
    return found


def _line(body: bytes, at: int) -> tuple[bytes, int]:
    end = body.find(b"\n", at)
    return (body[at:], len(body)) if end < 0 else (body[at:end], end + 1)


def envelope_items(body: bytes, max_bytes: int = MAX_BYTES, max_items: int = MAX_ITEMS, max_item_bytes: int = MAX_ITEM_BYTES) -> tuple[str, list[tuple[str, bytes]]]:
    """(event id of the header, [(item type, payload)]) of a newline-framed envelope."""
    if not body or len(body) > max_bytes:
        raise Rejected("malformed")
    line, at = _line(body, 0)
    head = _header(line, {"event_id": str, "dsn": str, "sent_at": str})
    items: list[tuple[str, bytes]] = []
    while at < len(body):
        line, at = _line(body, at)
        if not line.strip():
            continue
        if len(items) >= max_items:
            raise Rejected("malformed")
        item = _header(line, {"type": str, "length": int})
        if not item.get("type"):
            raise Rejected("malformed")
        length = item.get("length")
        if length is None:
            payload, at = _line(body, at)
            if len(payload) > max_item_bytes:
                raise Rejected("malformed")
        else:
            payload, end = body[at : at + max(length, 0)], at + length
            # the line break behind a counted payload may be missing at the end
            if not 0 <= length <= max_item_bytes or len(payload) < length or body[end : end + 1] not in (b"", b"\n"):
                raise Rejected("malformed")
            at = end + 1
        if item["type"] in ITEM_TYPES:
            items.append((item["type"], payload))
    return head.get("event_id") or "", items


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, items = [], []
        columns = (batch.column(c).to_pylist() for c in ("kind", "content_encoding", "body"))
        for row, (kind, encoding, body) in enumerate(zip(*columns, strict=True)):
            try:
                body = inflate(body or b"", encoding or "")
                if kind == SINGLE:
                    found = [(0, "event", "", body, None)]
                elif kind == ENVELOPE:
                    event_id, parts = envelope_items(body)
                    found = [(n, item_type, event_id, payload, None) for n, (item_type, payload) in enumerate(parts)]
                else:
                    raise Rejected("malformed")
            except Rejected as why:
                found = [(0, None, "", None, str(why))]
            of += [row] * len(found)
            items += found
        types = (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string())
        own = batch.select(["arrival_seq", "received_at", "project_id"]).take(pa.array(of, pa.int64()))
        made = [pa.array(values, kind) for values, kind in zip(zip(*items, strict=True) if items else [()] * len(types), types, strict=True)]
        yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*own.schema.names, "item_no", "item_type", "header_event_id", "payload", "reason"])


def decode_records(records: DataFrame) -> DataFrame:
    """One row per envelope item, or one with a reason per record that cannot be read."""
    columns = ("arrival_seq", "received_at", "kind", "project_id", "content_encoding", "body")
    return records.select(*columns).mapInArrow(_decode, ITEM)


def event_items(items: DataFrame) -> DataFrame:
    """Items that become events; other accepted types are left out, rejects stay."""
    return items.where(F.col("reason").isNotNull() | F.col("item_type").isin(*EVENT_TYPES))


def read_json_lines(spark: SparkSession, path: str, project_id: int, received_at: Column) -> DataFrame:
    """Records of a file of single JSON events, one a line."""
    lines = spark.read.text(path)
    return lines.select(
        F.monotonically_increasing_id().alias("arrival_seq"), received_at.alias("received_at"), F.lit(SINGLE).cast("tinyint").alias("kind"),
        F.lit(project_id).cast("bigint").alias("project_id"), F.lit("").alias("public_key"), F.lit("").alias("content_encoding"), F.col("value").cast("binary").alias("body"),
    )


def _kind(json_value: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(json_value, path, "variant")), F.lit("VOID"))


def _well_typed(v: Column) -> Column:
    """Typed fields have their type, or are null or missing."""
    text = ("event_id", "platform", "level", "release", "environment", "message", "logentry.formatted", "logentry.message", "user.id", "user.email")
    ok = F.schema_of_variant(v).startswith("OBJECT") | (F.schema_of_variant(v) == "VOID")
    for name in text:
        ok = ok & _kind(v, f"$.{name}").isin("STRING", "VOID")
    for name in ("logentry", "user"):
        kind = _kind(v, f"$.{name}")
        ok = ok & (kind.startswith("OBJECT") | (kind == "VOID"))
    return ok & _kind(v, "$.fingerprint").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")


def _text(v: Column, path: str) -> Column:
    return present(F.try_variant_get(v, f"$.{path}", "string"))


_LOOSE_FRAME = "struct<function: variant, module: variant, filename: variant, abs_path: variant, in_app: variant>"
_LOOSE = f"array<struct<type: variant, value: variant, stacktrace: struct<frames: array<{_LOOSE_FRAME}>>>>"


def parse_exceptions(raw: Column) -> Column:
    """Exceptions of a VARIANT that is {"values": [...]} or a bare array; of anything else, none."""
    whole = F.to_json(raw)
    values = F.when(F.schema_of_variant(raw).startswith("OBJECT"), F.from_json(whole, f"values {_LOOSE}")["values"])
    bare = F.when(F.schema_of_variant(raw).startswith("ARRAY"), F.from_json(whole, _LOOSE))
    is_text = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID")
    frames = lambda e: F.coalesce(e["stacktrace"]["frames"], F.from_json(F.lit("[]"), f"array<{_LOOSE_FRAME}>"))
    frame_ok = lambda f: (
        is_text(f["function"]) & is_text(f["module"]) & is_text(f["filename"]) & is_text(f["abs_path"])
        & F.coalesce(F.schema_of_variant(f["in_app"]), F.lit("VOID")).isin("BOOLEAN", "VOID")
    )
    text = lambda v: present(F.try_variant_get(v, "$", "string"))
    frame = lambda f: F.struct(
        *(text(f[c]).alias(c) for c in ("function", "module", "filename", "abs_path")), F.try_variant_get(f["in_app"], "$", "boolean").alias("in_app")
    )

    def strict(found: Column) -> Column:
        ok = F.forall(found, lambda e: is_text(e["type"]) & is_text(e["value"]) & F.forall(frames(e), frame_ok))
        one = lambda e: F.struct(text(e["type"]).alias("type"), text(e["value"]).alias("value"), F.transform(frames(e), frame).alias("frames"))
        return F.when(ok, F.transform(found, one))

    found = F.coalesce(F.when(F.size(values) > 0, values), bare)
    return F.coalesce(let(found, strict), F.array().cast(EXCEPTIONS))


#: Names of the fields that events are made from.
FIELDS = (
    "event_id", "timestamp", "platform", "level", "release", "environment", "message", "logentry", "formatted", "user", "id", "email", "fingerprint",
    "exception", "values", "type", "value", "stacktrace", "frames", "function", "module", "filename", "abs_path", "in_app",
)


def any_case(text: Column) -> Column:
    """JSON text with the names of known fields in lower case; text without a capital in them is left alone.

    Inside a JSON string a quotation mark follows a backslash, so only names match.
    """
    found = text
    for name in FIELDS:
        found = F.regexp_replace(found, f'([{{,]\\s*")(?i:{name})("\\s*:)', f"$1{name}$2")
    return F.when(text.rlike(f'[{{,]\\s*"(?=[^"]*[A-Z])(?i:{"|".join(FIELDS)})"\\s*:'), found).otherwise(text)


def extract_events(items: DataFrame) -> DataFrame:
    """Items with the event's columns and its basis; a payload that is no well-typed event gets reason malformed."""
    v = F.try_parse_json(any_case(F.decode("payload", "UTF-8")))
    parsed = items.withColumn("v", F.when(F.col("reason").isNull(), v))
    v = F.col("v")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(v.isNull() | ~_well_typed(v), "malformed")
    parsed = parsed.withColumn("reason", reason).withColumn("v", F.when(F.col("reason").isNull(), v))
    parsed = parsed.withColumn("exceptions", parse_exceptions(F.try_variant_get(v, "$.exception", "variant")))
    message = first_non_empty(_text(v, "logentry.formatted"), _text(v, "message"))
    own = F.transform(F.try_variant_get(v, "$.fingerprint", "array<string>"), present)
    grouping = F.struct(
        _text(v, "platform").alias("platform"), own.alias("sdk_fingerprint"), message.alias("message"),
        _text(v, "logentry.message").alias("message_template"), F.col("exceptions").alias("exceptions"),
    )
    last = F.try_element_at("exceptions", F.lit(-1))
    now = F.unix_micros("received_at") * 1000
    wire_id = F.lower(F.replace(_text(v, "event_id"), F.lit("-"), F.lit("")))
    return (
        parsed.withColumn("g", fingerprint(grouping))
        .withColumn("event_id", first_non_empty(wire_id, F.col("header_event_id")))
        .withColumn("ts_ns", parse_event_time(F.try_variant_get(v, "$.timestamp", "variant"), now))
        .withColumn("level", first_non_empty(_text(v, "level"), F.lit("error")))
        .withColumn("release", _text(v, "release"))
        .withColumn("environment", _text(v, "environment"))
        .withColumn("user_id", first_non_empty(_text(v, "user.id"), _text(v, "user.email")))
        .withColumn("message", first_non_empty(join_non_empty(present(last["type"]), present(last["value"])), _text(v, "logentry.formatted"), _text(v, "logentry.message"), _text(v, "message")))
        .withColumn("fingerprint", F.col("g.fingerprint"))
        .withColumn("basis", F.col("g.basis"))
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .drop("v", "g", "exceptions")
    )


def authenticate(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records with ``reason`` auth where no active key of the project matches.

    ``keys(project_id, public_key, is_active)`` is a dimension; Spark broadcasts it while it is small.
    """
    active = keys.where("is_active").select("project_id", "public_key").distinct().withColumn("known", F.lit(True))
    return records.join(active, ["project_id", "public_key"], "left").withColumn("reason", F.when(F.col("known").isNull(), "auth")).drop("known")


def with_org(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events with their project's org_id, null for an unknown project."""
    return events.join(projects.select(F.col("id").alias("project_id"), "org_id"), "project_id", "left")


def mark_duplicates(events: DataFrame) -> DataFrame:
    """Reason duplicate for all but the first arrival of a (project, event id); an empty id never repeats."""
    # Rows without an id get a key of their own, so they don't meet in one task.
    key = F.when(F.col("event_id") == "", F.concat_ws("-", F.lit("row"), "arrival_seq", "item_no")).otherwise(F.concat(F.lit("id-"), "event_id"))
    order = Window.partitionBy("project_id", "_key", F.col("reason").isNull()).orderBy("arrival_seq", "item_no")
    ranked = events.withColumn("_key", key).withColumn("_n", F.row_number().over(order))
    again = F.col("reason").isNull() & (F.col("_n") > 1)
    return ranked.withColumn("reason", F.when(again, "duplicate").otherwise(F.col("reason"))).drop("_key", "_n")


def classify(records: DataFrame, keys: DataFrame) -> DataFrame:
    """All items of ``records`` as event rows, with a reason where they are not to be stored; repeats are not looked for. Works on a stream."""
    checked = authenticate(records, keys)
    items = event_items(decode_records(checked.where("reason is null")))
    denied = checked.where("reason is not null").select(
        "arrival_seq", "received_at", "project_id", F.lit(0).alias("item_no"), F.lit(None).cast("string").alias("item_type"),
        F.lit("").alias("header_event_id"), F.lit(None).cast("binary").alias("payload"), "reason",
    )
    return extract_events(items.unionByName(denied))


def ingest(records: DataFrame, keys: DataFrame) -> DataFrame:
    """All items of ``records`` as classified event rows; ``reason`` is null for those to store."""
    return mark_duplicates(classify(records, keys))


def stored(classified: DataFrame) -> DataFrame:
    return classified.where("reason is null")


def rejected(classified: DataFrame) -> DataFrame:
    return classified.where("reason is not null").select("arrival_seq", "received_at", "project_id", "item_no", "reason")


def issue_hits(events: DataFrame, *more: str) -> DataFrame:
    """One hit per stored event, with ``more`` of its columns."""
    title = truncate_bytes(F.col("message"), TITLE_BYTES).alias("title")
    return events.select("arrival_seq", "project_id", "fingerprint", "basis", title, "level", F.col("ts_ns").alias("seen_at"), *more)


