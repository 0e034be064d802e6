import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import alerts, issues, query, quota
from faultgrain.schema import COMMAND, HIT, RECORD
from faultgrain.sources import store, versions
from faultgrain.streaming import consumers, ingest, state
from faultgrain.streaming import issues as stream_issues
from tests.test_operators import random_log, replay


def parts(spark, df, tmp_path, n, key):
    """The rows in ``n`` files, in order of ``key``, as a stream of one file per batch."""
    source = tmp_path / "source"
    source.mkdir()
    for k in range(n):
        df.where(F.col(key) % n == k).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    for k in range(n):
        file = next((tmp_path / f"p{k}").glob("*.parquet"))
        shutil.copy(file, source / f"{k}.parquet")
        os.utime(source / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))  # the source reads older files first
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drained(query_df, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.table(name)


def test_ingest_restarts_without_copies(spark, tmp_path):
    landing = tmp_path / "landing"
    keys = spark.createDataFrame([(1, "k", True)], "project_id bigint, public_key string, is_active boolean")
    now = datetime(2026, 1, 2)

    def land(first, n, key="k"):
        rows = [(first + i, now, 2, 1, key, "", json.dumps({"event_id": f"id{(first + i) % 30}", "message": "m"}).encode()) for i in range(n)]
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(str(landing))

    def run():
        stream = ingest.landing_stream(spark, str(landing), files_per_batch=1)
        ingest.start_ingest(stream, keys, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()

    land(0, 20)
    land(20, 20)
    run()
    land(100, 5, key="wrong")
    land(40, 10)
    run()
    out = str(tmp_path / "out")
    stored, rejects = ingest.stored(spark, out, "events"), ingest.stored(spark, out, "rejects")
    assert stored.count() == 30 and stored.select("event_id").distinct().count() == 30
    hits = ingest.stored(spark, out, "hits")
    assert hits.count() == 30 and sorted(r["fingerprint"] for r in hits.collect()) == sorted(r["fingerprint"] for r in stored.collect())
    assert query.scope(store.read_events(spark, str(tmp_path / "out/events")), 1).count() == 30 and issues.rollup(hits).agg(F.sum("times_seen")).collect()[0][0] == 30
    assert {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()} == {"duplicate": 20, "auth": 5}
    records = spark.read.parquet(str(landing)).where("public_key = 'k'").limit(3)
    for again in range(3):  # a replayed batch adds nothing
        ingest.ingest_batch(records, 77, keys, out)
        if again == 1:
            ingest.compact(spark, out)
    assert ingest.stored(spark, out, "rejects").where("batch_id = 77").count() == 3
    fresh = spark.createDataFrame([(900, now, 2, 1, "k", "", b'{"event_id":"new","message":"m"}')], RECORD)
    for table in ("rejects", "hits", None):  # dies before this table is written, then runs again
        with pytest.MonkeyPatch.context() as patch:
            original = versions.append_rows

            def dies(rows, path, *args, table=table, **more):
                if table and path.endswith(table):
                    raise KeyboardInterrupt
                return original(rows, path, *args, **more)

            patch.setattr(versions, "append_rows", dies)
            if table:
                with pytest.raises(KeyboardInterrupt):
                    ingest.ingest_batch(fresh, 78, keys, out)
            else:
                ingest.ingest_batch(fresh, 78, keys, out)
    ingest.compact(spark, out)
    ingest.ingest_batch(fresh, 78, keys, out)
    assert ingest.stored(spark, out, "events").where("event_id = 'new'").count() == 1 and ingest.stored(spark, out, "hits").count() == 31
    ingest.vacuum(spark, out, 0)
    assert ingest.stored(spark, out, "events").count() == 31 and len(list((tmp_path / "out/events").glob("commit=*"))) == 1


def test_keyed_ingest_forgets_ids_and_restarts(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    keys = spark.createDataFrame([(1, "k", True)], "project_id bigint, public_key string, is_active boolean")
    day = datetime(2026, 1, 2)
    seq = iter(range(10_000))

    def land(ids, at, key="k"):
        rows = [(next(seq), at, 2, 1, key, "", json.dumps({"event_id": i, "message": "m", "timestamp": 1_767_312_000.123456}).encode()) for i in ids]
        spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(str(landing))
        for file in landing.glob("*.parquet"):
            if file.name not in names:
                names.append(file.name)
                os.utime(file, (1_700_000_000 + len(names),) * 2)  # older files are read first

    names, progress = [], consumers.Progress()
    spark.streams.addListener(progress)

    def run():
        query = ingest.start_keyed_ingest(ingest.landing_stream(spark, str(landing), files_per_batch=1), keys, out, str(tmp_path / "check"), hold="1 hour", delay="1 minute", once=True)
        query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    land([f"a{k % 10}" for k in range(15)] + ["", ""], day)
    land(["a1", "b1"], day + timedelta(minutes=5), key="k")
    land(["a2"], day, key="wrong")
    assert max(run()) > 10
    land(["a3", "b1", "c1"], day + timedelta(minutes=30))
    run()  # a restart knows what came before
    land(["d1"], day + timedelta(hours=3))
    land(["a1", "d1"], day + timedelta(hours=3, minutes=1))  # a1 is forgotten, d1 is not
    left = run()
    stored = ingest.stored(spark, out, "events")
    ids = sorted(r["event_id"] for r in stored.collect())
    assert ids == sorted(["", "", *(f"a{k}" for k in range(10)), "b1", "c1", "d1", "a1"])
    assert {r["ts_ns"] for r in stored.select("ts_ns").collect()} == {1_767_312_000_123_456_000}
    assert {r["reason"]: r["count"] for r in ingest.stored(spark, out, "rejects").groupBy("reason").count().collect()} == {"duplicate": 9, "auth": 1}
    assert left[-1] <= 6  # ids of the last hour and their timers
    spark.streams.removeListener(progress)
    assert sum(b["rows"] for b in progress.batches) >= 17 + 2 + 1 + 3 + 1 + 2 and progress.batches[-1]["state_rows"] == left[-1]


def test_consumers_lag_and_retention(spark, tmp_path):
    """Two consumers at different places: exact lag of each, and only what both have read goes, whole directories, oldest first."""
    landing = tmp_path / "landing"

    def land(day, first, n):
        rows = [(first + k, datetime(2026, 1, day), 2, 1, "k", "", b"x" * 500) for k in range(n)]
        spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(str(landing / f"day=2026-01-0{day}"))
        for file in (landing / f"day=2026-01-0{day}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 86400 * day,) * 2)

    def consume(name, **bounds):
        stream = ingest.landing_stream(spark, str(landing), **bounds)
        query = stream.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return [p.numInputRows for p in query.recentProgress if p.numInputRows]

    both = {name: str(tmp_path / name) for name in ("fast", "slow")}
    lag = lambda: {r["consumer"]: (r["files"], r["records"]) for r in consumers.lag(spark, str(landing), both).collect()}
    now = 1_700_000_000 * 10**9 + 10 * 86400 * 10**9
    drop = lambda **k: [d[-1] for d in consumers.drop_consumed(spark, str(landing), both, now_ns=now, **k)]
    land(1, 0, 40)
    land(2, 100, 30)
    assert lag() == {"fast": (2, 70), "slow": (2, 70)} and drop(max_bytes=1) == []
    consume("fast")
    consume("slow")
    land(3, 200, 20)
    land(4, 300, 25)
    sizes = sorted(f.stat().st_size for f in landing.glob("*/*.parquet"))
    assert consume("fast", bytes_per_batch=sizes[-1]) == [20, 25]  # a batch ends where the next file would be too much
    land(5, 400, 5)
    assert lag() == {"fast": (1, 5), "slow": (3, 50)}
    assert consumers.drop_consumed(spark, str(landing), {}, now_ns=now, max_bytes=1) == []
    assert drop(max_age_ns=1) == ["1", "2"]  # the third is unread by one of them
    assert lag() == {"fast": (1, 5), "slow": (3, 50)}
    consume("slow", files_per_batch=1)
    consume("fast")
    assert lag() == {"fast": (0, 0), "slow": (0, 0)} and drop(max_age_ns=int(6.5 * 86400 * 10**9)) == ["3"]
    assert drop(max_bytes=1) == ["4"] and sorted(d.name[-1] for d in landing.iterdir()) == ["5"]


def test_issue_batches_write_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "out")
    none = spark.createDataFrame([], COMMAND)
    row = lambda seq, k: (seq, k % 3, f"f{k}", "b", "t", "error", 1)
    stream_issues.issues_batch(stream_issues.log_rows(spark.createDataFrame([row(k, k) for k in range(2000)], HIT), none), 0, path)
    stored = lambda n: versions.read(spark, f"{path}/issues", stream_issues.STORED).where(F.col("batch") == n).count()
    assert stored(0) == 2000
    merge = spark.createDataFrame([(5000, 0, "merge", None, "f0", ["f3", "f6"], None)], COMMAND)
    stream_issues.issues_batch(stream_issues.log_rows(spark.createDataFrame([row(4000 + k, 3 * k) for k in range(20)], HIT), merge), 1, path)
    assert stored(1) == 20
    stream_issues.issues_batch(stream_issues.log_rows(spark.createDataFrame([row(6000, 3)], HIT), none), 2, path)
    assert stored(2) == 1  # a hit on a merged issue counts for its target
    now = {r["fingerprint"]: (r["times_seen"], r["merged_into"]) for r in stream_issues.current_issues(spark, path).collect()}
    assert len(now) == 2000 and now["f0"] == (7, None) and now["f3"] == (2, "f0") and now["f1"] == (1, None)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(stream_issues, "DELTAS", 1)
        stream_issues.issues_batch(stream_issues.log_rows(spark.createDataFrame([row(7000, 9)], HIT), none), 3, path)
    assert versions.read(spark, f"{path}/issues", stream_issues.STORED).count() == 2000  # folded
    assert {r["fingerprint"]: r["times_seen"] for r in stream_issues.current_issues(spark, path).collect()} == {f: n + (f == "f9") for f, (n, _) in now.items()}
    stream_issues.vacuum(spark, path, 0)
    assert stream_issues.current_issues(spark, path).count() == 2000


def test_repeats_and_counts(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(n, start + timedelta(seconds=20 * (n % 100)), n % 2, "" if n % 10 == 0 else f"e{n % 100}") for n in range(150)]
    df = spark.createDataFrame(rows, "n bigint, ts timestamp_ntz, project_id bigint, event_id string")
    stream = parts(spark, df, tmp_path, 3, "n")
    assert drained(ingest.drop_repeats(stream, "2 hours"), "repeats").count() == 90 + 15


def test_tumbling_counts(spark, tmp_path):
    start = datetime(2026, 1, 1)
    df = spark.createDataFrame([(n // 50, start + timedelta(seconds=20 * n), n % 2) for n in range(150)], "batch bigint, ts timestamp_ntz, project_id bigint")
    counts = drained(ingest.tumbling_counts(parts(spark, df, tmp_path, 3, "batch"), "5 minutes", "1 minute"), "counts")
    expected = {(p, start + timedelta(minutes=5 * w)): sum(n % 2 == p and 20 * n // 300 == w for n in range(150)) for p in (0, 1) for w in range(10)}
    last = max(w for _, w in expected)  # the watermark has not passed it yet
    assert {(r["project_id"], r["start"]): r["count"] for r in counts.collect()} == {k: n for k, n in expected.items() if k[1] < last}


def _timeline(spark):
    hits = spark.range(300).select((F.col("id") * 2).alias("arrival_seq"), (F.col("id") % 2).alias("project_id"), F.concat(F.lit("f"), F.col("id") % 3).alias("fingerprint"), F.lit("b").alias("basis"), F.lit("t").alias("title"), F.lit("error").alias("level"), F.col("id").alias("seen_at"))
    hits = spark.createDataFrame(hits.collect(), HIT)
    commands = spark.createDataFrame([(101, 0, "status", "f0", None, None, "resolved"), (301, 1, "status", "f2", None, None, "ignored"), (303, 1, "status", "f2", None, None, "resolved")], COMMAND)
    return hits, commands, issues.timeline(hits, commands)


def test_streaming_issues(spark, tmp_path):
    hits, commands, batch = _timeline(spark)
    rows = hits.select("arrival_seq", "project_id", F.col("fingerprint").alias("target"), F.lit("hit").alias("row"), F.lit(1).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("set_status"))
    rows = rows.unionByName(commands.select("arrival_seq", "project_id", F.col("fingerprint").alias("target"), F.lit("status").alias("row"), F.lit(0).cast("bigint").alias("weight"), F.col("status").alias("set_status")))
    stream = parts(spark, rows.withColumn("batch", F.floor(F.col("arrival_seq") / 150)), tmp_path, 4, "batch")
    columns = ["project_id", "target", "arrival_seq", "is_new", "regressed", "times_seen", "status"]
    found = drained(state.issue_outcomes(stream), "outcomes").select(*columns)
    assert sorted(found.collect()) == sorted(batch.select(*columns).collect())
    assert found.where("regressed").count() == 2


def test_streaming_issues_with_merges(spark, tmp_path):
    """Random hits, merges, splits and status commands in three batches equal a replay of the whole log."""
    hits, commands = random_log()
    log = stream_issues.log_rows(spark.createDataFrame(hits, HIT), spark.createDataFrame(commands, COMMAND)).withColumn("batch", F.floor(F.col("arrival_seq") / 400))
    stream_issues.start_issues(parts(spark, log, tmp_path, 3, "batch").drop("batch"), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    stream_issues.issues_batch(log.where("batch = 2").drop("batch"), 2, str(tmp_path / "out"))  # a replay
    expected, live = replay(hits, commands)
    line = stream_issues.outcomes(spark, str(tmp_path / "out")).collect()
    assert len(line) == len(hits) and {(r["project_id"], r["arrival_seq"]): (r["target"], r["is_new"], r["regressed"], r["times_seen"], r["status"]) for r in line} == expected
    now = {(r["project_id"], r["fingerprint"]): (r["status"], r["times_seen"], r["merged_into"], r["last_seen"], r["level"]) for r in stream_issues.current_issues(spark, str(tmp_path / "out")).collect()}
    assert now == {k: (i["status"], i["n"], i["into"], i["last"], i["level"]) for k, i in live.items()}


def test_streaming_alerts(spark, tmp_path):
    activity = _timeline(spark)[2].withColumnRenamed("target", "issue").withColumn("ts", F.timestamp_seconds(F.col("arrival_seq") * 10)).select("arrival_seq", "project_id", "issue", "ts", "title", "level", "status", "times_seen", "is_new", "regressed")
    rules = spark.createDataFrame([(1, 0, "new", "new_issue", 0, True), (2, 0, "many", "frequency", 20, True), (3, 1, "back", "regression", 0, True)], "id bigint, project_id bigint, name string, condition string, threshold bigint, enabled boolean")
    activity = spark.createDataFrame(activity.collect(), activity.schema).withColumn("batch", F.floor(F.col("arrival_seq") / 150))
    fired = drained(state.alert_firings(parts(spark, activity, tmp_path, 4, "batch"), rules), "fired").select("rule_id", "issue", "arrival_seq")
    assert sorted(fired.collect()) == sorted(alerts.firings(activity, rules).select("rule_id", "issue", "arrival_seq").collect())


def test_cooldown_state_expires(spark, tmp_path):
    start = datetime(2026, 1, 1)
    schema = "arrival_seq bigint, project_id bigint, issue string, ts timestamp, title string, level string, status string, times_seen bigint, is_new boolean, regressed boolean, batch bigint"
    at = lambda seq, minutes, issue, batch: (seq, 0, issue, start + timedelta(minutes=minutes), "t", "error", "unresolved", 1, True, False, batch)
    rows = [at(n, n * 0.1, f"i{n % 5}", 0) for n in range(20)] + [at(30, 4, "i0", 1), at(31, 5.2, "i1", 1)] + [at(40, 60, "last", 2)] + [at(50, 200, "i0", 3), at(51, 200, "i0", 3)] + [at(60, 400, "end", 4)]
    activity = spark.createDataFrame(rows, schema)
    rules = spark.createDataFrame([(1, 0, "new", "new_issue", 0, True)], "id bigint, project_id bigint, name string, condition string, threshold bigint, enabled boolean")
    query = state.alert_firings(parts(spark, activity, tmp_path, 5, "batch"), rules, 300, "0 seconds").writeStream.format("memory").queryName("expiring").trigger(availableNow=True).start()
    query.awaitTermination()
    fired = {(r["issue"], r["arrival_seq"]) for r in spark.table("expiring").collect()}
    assert fired == {(r["issue"], r["arrival_seq"]) for r in alerts.firings(activity, rules, 300).collect()}
    counts = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(counts) >= 5 and counts[-1] <= 2  # the last firing's state and timer are left, no other


def test_streaming_quota(spark, tmp_path):
    limits = spark.createDataFrame([(0, 0.5, 4.0)], "project_id bigint, per_second double, burst double")
    arrivals = spark.range(400).select((F.col("id") % 2).alias("project_id"), F.col("id").alias("arrival_seq"), (F.col("id") * 600_000_000).alias("ts_ns")).withColumn("batch", F.floor(F.col("arrival_seq") / 100))
    admitted = drained(state.admissions(parts(spark, arrivals, tmp_path, 4, "batch"), limits), "admitted").select("project_id", "arrival_seq", "admitted")
    assert sorted(admitted.collect()) == sorted(quota.admit(arrivals, limits).select("project_id", "arrival_seq", "admitted").collect())
