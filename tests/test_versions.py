"""The log of versions: replays, compaction, crashes and readers agree on one copy of each row."""

import threading

import pytest
from pyspark.sql import functions as F

from faultgrain.operators import query
from faultgrain.sources import store, versions
from tests.test_operators import HOUR, START, events

ROWS = "k bigint, day string"


def ids(spark, path):
    return sorted(r["event_id"] for r in store.read_events(spark, path).select("event_id").collect())


def batch(spark, n, rows=50):
    return events(spark, 2, 1, rows).withColumn("event_id", F.concat(F.lit(f"b{n}-"), "event_id"))


def test_replay_after_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 1, 2):
        store.write_events(batch(spark, n), path, writer="w", batch=n)
    once = ids(spark, path)
    assert len(once) == len(set(once)) == 200
    store.compact(spark, path)
    for n in (1, 2):
        store.write_events(batch(spark, n), path, writer="w", batch=n)
    assert ids(spark, path) == once
    store.write_events(batch(spark, 1), path, writer="another", batch=1)  # a stream of its own
    assert len(ids(spark, path)) == 300


def test_crash_in_write_and_in_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_events(batch(spark, 1), path, writer="w", batch=1)
    store.write_events(batch(spark, 2), path, writer="w", batch=2)
    once, publish = ids(spark, path), versions._publish

    def dies(*args):
        raise KeyboardInterrupt

    for action in (lambda: store.compact(spark, path), lambda: store.write_events(batch(spark, 3), path, writer="w", batch=3)):
        monkeypatch.setattr(versions, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            action()
        assert ids(spark, path) == once
        assert query.stored_window_stats(spark, path, 1).collect()[0]["total"] == 100
    monkeypatch.setattr(versions, "_publish", publish)
    store.write_events(batch(spark, 3), path, writer="w", batch=3)
    store.compact(spark, path)
    assert len(ids(spark, path)) == len(set(ids(spark, path))) == 300
    store.vacuum(spark, path, 0)
    assert len(list(tmp_path.glob("t/commit=*"))) == len(list(tmp_path.glob("t/_rollup/commit=*"))) == len(list(tmp_path.glob("t/_users/commit=*"))) == 1
    assert len(ids(spark, path)) == 300 and query.stored_window_stats(spark, path, 1, exact=True).collect()[0]["total"] == 150


def test_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_events(batch(spark, 1), path)
    store.write_events(batch(spark, 2), path)
    before, seen = store.read_events(spark, path), []
    original = versions._publish

    def publish(spark_, path_, version):
        seen.append((store.read_events(spark, path).count(), before.count()))  # all is written, nothing is published
        done = original(spark_, path_, version)
        seen.append((store.read_events(spark, path).count(), before.count()))
        return done

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(versions, "_publish", publish)
        store.compact(spark, path)
        store.write_events(batch(spark, 3), path)
    assert seen == [(200, 200), (200, 200), (200, 200), (300, 200)]
    store.vacuum(spark, path, 3600)
    assert before.count() == 200  # a young version keeps its files
    store.vacuum(spark, path, 0)
    assert store.read_events(spark, path).count() == 300


def test_appends_meanwhile_stay_and_second_compaction_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for n in (1, 2):
        store.write_events(batch(spark, n), path)
    original, write = versions._publish, store._commit_files

    def slow(*args, **more):
        found = write(*args, **more)
        monkeypatch.setattr(store, "_commit_files", write)
        store.write_events(batch(spark, 3), path)
        return found

    monkeypatch.setattr(store, "_commit_files", slow)
    store.compact(spark, path)
    assert len(set(ids(spark, path))) == len(ids(spark, path)) == 300

    def beaten(*args, **more):
        found = write(*args, **more)
        monkeypatch.setattr(store, "_commit_files", write)
        store.compact(spark, path)
        return found

    monkeypatch.setattr(store, "_commit_files", beaten)
    with pytest.raises(versions.Conflict):
        store.compact(spark, path)
    assert len(set(ids(spark, path))) == len(ids(spark, path)) == 300
    assert versions._publish is original


def test_commits_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10).select(F.col("id").alias("k"), F.lit("d").alias("day"))
    threads = [threading.Thread(target=lambda n=n: versions.append_rows(rows.withColumn("k", F.col("k") + 10 * n), path, "day", writer=f"w{n % 4}", batch=n)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = versions.latest(spark, path)
    # Of the two batches of a writer the later one always counts, the earlier one if it came first.
    assert last.number == len(last.live) and {f"w{n}": n + 4 for n in range(4)} == last.writers
    assert versions.read(spark, path, ROWS).count() == 10 * last.number


def test_hundred_batches_leave_no_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3).select(F.col("id").alias("k"), F.lit("d").alias("day")).coalesce(1)
    for n in range(100):
        versions.append_rows(rows.withColumn("k", F.lit(n).cast("bigint")), path, "day", writer="w", batch=n)
        if n % 25 == 24:
            versions.fold(spark, path, ROWS, "day")
            versions.vacuum(spark, path, 0)
    assert sorted(r["k"] for r in versions.read(spark, path, ROWS).collect()) == sorted(list(range(100)) * 3)
    assert len(list(tmp_path.glob("t/commit=*"))) == 1 and len(list(tmp_path.glob("t/_versions/*"))) == 1
    assert versions.latest(spark, path).writers == {"w": 99}


def test_dropped_days(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_events(events(spark, 2, 60, 5), path)
    store.write_events(events(spark, 2, 30, 5), path)
    before = store.read_events(spark, path)
    assert store.drop_before(spark, path, "2026-07-29") == ["event_date=2026-07-28"] and store.drop_before(spark, path, "2026-07-29") == []
    assert before.count() == 900 and store.read_events(spark, path).count() == 900 - 2 * 2 * 24 * 5
    assert query.stored_window_stats(spark, path, 1).collect()[0]["total"] == (36 + 6) * 5
    assert query.matching(store.read_events(spark, path), 1, since=START, until=START + 24 * HOUR - 1).count() == 0
    store.vacuum(spark, path, 0)
    assert {d.name for d in tmp_path.glob("t/commit=*/event_date=*")} == {"event_date=2026-07-29", "event_date=2026-07-30"}
    assert store.read_events(spark, path).count() == 420


def test_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.read_events(spark, path).count() == 0 and store.stored_manifest(spark, path).count() == 0
    store.write_events(events(spark, 1, 1, 1).where("false"), path, writer="w", batch=0)
    assert versions.is_done(spark, path, "w", 0) and store.read_events(spark, path).count() == 0
    assert query.stored_window_stats(spark, path, 1, exact=True).collect()[0]["unique_users"] == 0
    store.compact(spark, path)
    assert versions.latest(spark, path).number == 1
