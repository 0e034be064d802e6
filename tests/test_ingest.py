import gzip
import json
import random
import zlib
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultgrain.operators import ops
from faultgrain.schema import RECORD
from faultgrain.sources import ingest

NOW = datetime(2026, 1, 2, 3, 4, 5)
EVENT = b'{"event_id":"DEAD-BEEF","message":"hi"}'


def test_envelope_shapes():
    body = b'{"event_id":"abc"}\n{"type":"event","length":5}\nab\ncd\n\n{"type":"session"}\n{}\n{"type":"strange"}\nx\n{"type":"transaction","length":1}\ny'
    assert ingest.envelope_items(body) == ("abc", [("event", b"ab\ncd"), ("session", b"{}"), ("transaction", b"y")])
    assert ingest.envelope_items(b"{}\n") == ("", [])
    assert ingest.envelope_items(b'null\n{"type":"event"}') == ("", [("event", b"")])


@pytest.mark.parametrize(
    "body",
    [
        b"", b"nope\n", b"[]\n", b'{"event_id":5}\n', b'{}\n{"length":1}\nx', b'{}\n{"type":""}\nx', b'{}\n{"type":"event","length":9}\nabc', b'{}\n{"type":"event","length":-1}\n',
        b'{}\n{"type":"event","length":1}\nab', b"{}\n" + b'{"type":"event"}\nx\n' * 51, b'{}\n{"type":"event","length":99999999}\nx', b'{}\n{"type":"event","length":1.5}\nx',
    ],
)
def test_malformed_envelopes(body):
    with pytest.raises(ingest.Rejected, match="malformed"):
        ingest.envelope_items(body)


def test_random_bytes_are_read_or_rejected():
    rng = random.Random(7)
    seed = b'{"event_id":"a"}\n{"type":"event","length":3}\nabc\n{"type":"event"}\n{}\n'
    for _ in range(500):
        body = bytearray(seed)
        for _ in range(rng.randint(1, 6)):
            body[rng.randrange(len(body))] = rng.randrange(256)
        try:
            _, items = ingest.envelope_items(bytes(body))
            assert len(items) <= ingest.MAX_ITEMS
        except ingest.Rejected as why:
            assert str(why) == "malformed"


def test_inflate():
    plain = b"x" * 5000
    zstd = pa.compress(plain, codec="zstd", asbytes=True)
    for encoding, body in (("", plain), ("identity", plain), ("GZIP", gzip.compress(plain)), ("deflate", zlib.compress(plain)), ("zstd", zstd)):
        assert ingest.inflate(body, encoding) == plain
        if encoding not in ("", "identity"):
            with pytest.raises(ingest.Rejected, match="too_large"):
                ingest.inflate(body, encoding, limit=4000)
    for encoding, body in (("gzip", b"junk"), ("br", b"x"), ("deflate", zlib.compress(plain)[:9]), ("zstd", b"junk")):
        with pytest.raises(ingest.Rejected, match="malformed"):
            ingest.inflate(body, encoding)


def classified(spark, bodies):
    rows = [(n, NOW, kind, 1, key, "", body) for n, (kind, key, body) in enumerate(bodies)]
    keys = spark.createDataFrame([(1, "k", True), (1, "old", False), (2, "other", True)], "project_id bigint, public_key string, is_active boolean")
    return ingest.ingest(spark.createDataFrame(rows, RECORD), keys)


def test_end_to_end(spark):
    envelope = b'{"event_id":"HEAD-ID"}\n{"type":"event"}\n{"message":"no id"}\n{"type":"attachment"}\nzz\n{"type":"event"}\n{"event_id":"a-B","level":"info"}\n'
    bodies = [(2, "k", EVENT), (2, "k", EVENT), (1, "k", envelope), (2, "old", EVENT), (2, "other", EVENT), (2, None, EVENT), (2, "k", b"["), (9, "k", EVENT), (2, "k", b"{}"), (2, "k", b"{}")]
    done = classified(spark, bodies)
    stored = {(r["arrival_seq"], r["item_no"]): r for r in ingest.stored(done).collect()}
    assert {k: v["event_id"] for k, v in stored.items()} == {(0, 0): "deadbeef", (2, 0): "HEAD-ID", (2, 2): "ab", (8, 0): "", (9, 0): ""}
    assert stored[0, 0]["level"] == "error" and stored[2, 2]["level"] == "info" and stored[8, 0]["ts_ns"] == 1767323045 * 10**9
    assert {r["reason"]: r["count"] for r in ops.drops_by_reason(done).collect()} == {"duplicate": 1, "auth": 3, "malformed": 2}
    ops.require_accounted(done, ingest.stored(done), ingest.rejected(done))
    with pytest.raises(ops.Unaccounted):
        ops.require_accounted(done, ingest.stored(done), ingest.rejected(done).limit(1))


@pytest.mark.parametrize(
    ("event", "ok"),
    [
        ({"user": {"id": 5}}, False), ({"user": {"id": None, "email": "e"}}, True), ({"user": []}, False), ({"level": 1}, False), ({"fingerprint": ["a", None]}, True), ({"fingerprint": [1]}, False),
        ({"logentry": "x"}, False), ({"message": None}, True), ({"extra": {"any": [1, "x"]}}, True), ({"exception": 5}, True), ([], False),
    ],
)
def test_strict_types(spark, event, ok):
    row = classified(spark, [(2, "k", json.dumps(event).encode())]).collect()[0]
    assert (row["reason"] is None) is ok


def test_exception_shapes(spark):
    values = [{"type": "A", "value": "first"}, {"type": "ValueError", "value": "bad input", "stacktrace": {"frames": [{"function": "f", "module": "m", "in_app": True}]}}]
    bodies = [{"exception": {"values": values}}, {"exception": values}, {"exception": {"values": [{"type": 5}]}, "message": "m"}, {"exception": {"values": []}, "logentry": {"message": "t %s", "formatted": "t 1"}}]
    rows = {r["arrival_seq"]: r for r in classified(spark, [(2, "k", json.dumps(b).encode()) for b in bodies]).collect()}
    assert rows[0]["message"] == rows[1]["message"] == "ValueError: bad input"
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] and rows[0]["basis"] == "stacktrace"
    assert (rows[2]["message"], rows[2]["basis"]) == ("m", "message")
    assert (rows[3]["message"], rows[3]["basis"]) == ("t 1", "message-template")


def test_names_in_any_case(spark):
    event = {"Event_ID": "A-B", "MESSAGE": 'say {"Message": 1}, "LEVEL": 2', "Level": "info", "user": {"ID": "u1"}, "Tags": {"Mode": "X"}, "exception": {"Values": [{"TYPE": "E", "value": "V", "stackTrace": {"Frames": [{"Function": "f", "In_App": True}]}}]}}
    plain = {"event_id": "C-D", "message": event["MESSAGE"], "level": "info", "user": {"id": "u1"}, "exception": {"values": [{"type": "E", "value": "V", "stacktrace": {"frames": [{"function": "f", "in_app": True}]}}]}}
    envelope = b'{"EVENT_ID":"HEAD"}\n{"Type":"event","LENGTH":2}\n{}\n'
    one, two, three, twice = classified(spark, [(2, "k", json.dumps(event).encode()), (2, "k", json.dumps(plain, separators=(" , ", " : ")).encode()), (1, "k", envelope), (2, "k", b'{"message":"a","Message":"b"}')]).orderBy("arrival_seq").collect()
    assert (one["event_id"], two["event_id"], three["event_id"], twice["reason"]) == ("ab", "cd", "HEAD", "malformed")
    for column in ("message", "level", "user_id", "fingerprint", "basis", "reason"):
        assert one[column] == two[column]
    assert one["basis"] == "stacktrace" and json.loads(bytes(one["payload"])) == event
    messages = [r["message"] for r in classified(spark, [(2, "k", json.dumps({k: event["MESSAGE"], "level": "info"}).encode()) for k in ("message", "MESSAGE")]).collect()]
    assert messages == [event["MESSAGE"]] * 2


def test_json_lines(spark, tmp_path):
    """A file of single events, one a line; a line that is none is rejected."""
    (tmp_path / "e.json").write_text('{"event_id":"A-B","message":"one","level":"info"}\nnone\n{"event_id":"cd","message":"two","user":{"email":"x@y.zz"}}\n')
    records = ingest.read_json_lines(spark, str(tmp_path / "e.json"), 7, F.lit(NOW))
    keys = spark.createDataFrame([(7, "", True)], "project_id bigint, public_key string, is_active boolean")
    rows = ingest.ingest(records, keys).orderBy("arrival_seq").collect()
    assert [(r["project_id"], r["event_id"], r["message"], r["level"], r["user_id"], r["reason"]) for r in rows if r["reason"] is None] == [(7, "ab", "one", "info", "", None), (7, "cd", "two", "error", "x@y.zz", None)]
    assert [r["reason"] for r in rows].count("malformed") == 1
    assert ops.ingest_status(records, ingest.ingest(records.limit(2), keys)).collect()[0].asDict() == {"received": 3, "stored": 1, "dropped": 1, "lag": 1, "segments": 1}


def test_consumer_lag():
    progress = {"numInputRows": 10, "inputRowsPerSecond": 5.0, "processedRowsPerSecond": 2.0}
    assert ops.consumer_lag(progress) == {"rows": 10, "in_per_second": 5.0, "out_per_second": 2.0, "behind_per_second": 3.0}
    assert ops.consumer_lag(None)["behind_per_second"] == 0


def test_records_are_decoded_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """However large the table, a task decodes no more records than fit its time."""
    from faultgrain.plans import queries, tables

    made = "id AS event_id, timestamp_seconds(id) AS ts, id % 9 AS user_id, 'click' AS event_type, 1.0D AS value, '{}' AS props"
    spark.range(5000).selectExpr(*made.split(", ")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "RECORDS", 300)
    sizes = queries._records(spark, str(tmp_path)).where("arrival_seq < 1000000000").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and max(r["count"] for r in sizes) <= 350
    assert tables.spread(spark.range(0, 10, 1, 3)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
