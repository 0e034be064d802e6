import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultgrain.functions.ordered import dealt
from faultgrain.operators import access, alerts, issues, query, quota
from faultgrain.schema import COMMAND, HIT
from faultgrain.sources import store

HOUR = query.HOUR_NS
START = 1785196800 * 10**9


def events(spark, projects, hours, n):
    ids = spark.range(projects * hours * n)
    i, h, p = F.col("id") % n, F.floor(F.col("id") / n) % hours, F.floor(F.col("id") / (n * hours)) + 1
    return ids.select(
        F.concat_ws("-", F.lit("e"), p, h, i).alias("event_id"), p.alias("project_id"), (F.lit(START) + h * HOUR + i * 10**9).alias("ts_ns"),
        F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), (i % 3 + 1).cast("int")).alias("level"), F.concat(F.lit("fp-"), i % 50).alias("fingerprint"),
        F.concat(F.lit("1."), i % 4, F.lit(".0")).alias("release"), F.lit("production").alias("environment"), F.concat(F.lit("u"), i % 100).alias("user_id"),
        F.lit("m").alias("message"), F.lit(b"{}").alias("payload"), F.lit(1).alias("schema_version"),
    )


@pytest.mark.parametrize("by_hour", [True, False])
def test_event_table_prunes(spark, tmp_path, by_hour):
    path = str(tmp_path / "t")
    store.write_events(events(spark, 6, 4, 200), path, by_hour=by_hour)
    table = store.read_events(spark, path)
    found = query.matching(table, 3, since=START + 2 * HOUR, until=START + 2 * HOUR + 10**12)
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    if by_hour:
        assert len({f.split("/")[-2] + f.split("/")[-3] for f in found.inputFiles()}) == 24  # all directories are listed, one is read:
        assert {r[0].split("/")[-2] for r in found.select(F.input_file_name()).distinct().collect()} == {"hour=2026072802"}
    files = len(table.inputFiles())
    store.write_events(events(spark, 1, 1, 5).withColumn("event_id", F.lit("late")), path, by_hour=by_hour)
    assert table.count() == 4800 and store.read_events(spark, path).count() == 4805  # new commits are seen by reading again
    store.compact(spark, path)
    again = store.read_events(spark, path)
    assert again.count() == 4805 and len(again.inputFiles()) <= files
    store.write_events(events(spark, 1, 1, 1).withColumn("schema_version", F.lit(9)), path, by_hour=by_hour)
    with pytest.raises(Exception, match=store.UNKNOWN_VERSION):
        store.read_events(spark, path).count()
    assert query.scope(store.read_events(spark, path), 3, START, START + HOUR).count()  # reads no such row


def test_buckets_of_large_days(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(store, "BUCKET_ROWS", 100)
    store.write_events(events(spark, 6, 2, 40), path)
    store.write_events(events(spark, 6, 30, 1), path, buckets=4)
    store.compact(spark, path)
    names = {d.name for d in tmp_path.glob("t/commit=*/event_date=*/project_bucket=*")}
    assert any(n.endswith("-8") for n in names)
    live = store.versions.latest(spark, path)
    assert sum(n for found in live.live.values() for n in found.values()) == 660  # the log knows the rows of each directory
    for project in range(1, 7):
        found = query.scope(store.read_events(spark, path), project, START, START + 40 * HOUR)
        assert found.count() == 110
    day = [r[0] for r in query.scope(store.read_events(spark, path), 3, START, START).select(F.input_file_name()).distinct().collect()]
    assert len(day) == 1
    with pytest.raises(ValueError, match="power of two"):
        store.write_events(events(spark, 1, 1, 1), path, buckets=3)


def test_statistics(spark):
    hot = events(spark, 1, 1, 30).withColumn("event_id", F.concat(F.lit("hot"), "event_id"))
    both = store.union_tiers(hot, events(spark, 1, 3, 120))
    row = query.window_stats(both, 1, 0, 0, exact=True).collect()[0]
    assert row["total"] == 390 and [b["count"] for b in row["buckets"]] == [150, 120, 120]
    assert {k["key"] for k in row["top_by"]["level"]} == {"error", "warning", "info"} and len(row["top_by"]["fingerprint"]) == 10
    assert row["unique_users"] == 100
    assert query.scan(both, 1, 42).count() == 42 and query.matching(both, 1, release="9.9.9").count() == 0
    for bad in (None, 0):
        with pytest.raises(ValueError, match="project"):
            query.scope(both, bad)


def test_stored_statistics(spark, tmp_path):
    """Of a table of several commits, before and after compaction: what the rows give, from whole hours and edge rows."""
    path = str(tmp_path / "t")
    everything = events(spark, 3, 60, 40).withColumn("user_id", F.when(F.col("project_id") == 2, "").otherwise(F.concat("user_id", F.col("ts_ns") % 7)))
    spans = [(0, 0), (START + 5, START + 3 * HOUR - 7), (START + 10**10, 0), (0, START + 50 * HOUR), (START + HOUR // 2, START + HOUR // 2 + 10**10), (START + HOUR, START + 47 * HOUR - 1), (START + 25 * HOUR + 1, START + 59 * HOUR)]
    for part in (F.col("ts_ns") % 4 == 0, (F.col("ts_ns") % 4 == 1) & (F.col("ts_ns") < START + 40 * HOUR), F.col("ts_ns") % 4 == 2, (F.col("ts_ns") % 4 == 3) | ((F.col("ts_ns") % 4 == 1) & (F.col("ts_ns") >= START + 40 * HOUR))):
        store.write_events(everything.where(part), path)
    rows = spark.createDataFrame(everything.collect(), everything.schema).cache()
    for compacted in (False, True):
        if compacted:
            store.compact(spark, path)
            assert len(store.versions.latest(spark, path).live) == 1
        for since, until in spans:
            for project, width in ((1, HOUR), (2, 24 * HOUR)):
                expected = query.window_stats(rows, project, width, exact=True, since=since, until=until).collect()[0]
                found = query.stored_window_stats(spark, path, project, since=since, until=until, width=width, exact=True)
                assert found.collect()[0].asDict(True) == expected.asDict(True)
                sketch = query.unique_users_of_hours(spark, path, project, since, until).collect()[0][0]
                assert abs(sketch - expected["unique_users"]) <= 0.05 * expected["unique_users"]
                assert sketch == query.stored_window_stats(spark, path, project, since=since, until=until).collect()[0]["unique_users"]
        # Rows are read of the directories at the edges alone.
        files = query.stored_window_stats(spark, path, 1, since=START + 5, until=START + 59 * HOUR, exact=True).inputFiles()
        days = {f.split("event_date=")[1][:10] for f in files if "_rollup" not in f and "_users" not in f}
        assert days == {"2026-07-28", "2026-07-30"}
        assert all("_rollup" in f or "_users" in f for f in query.stored_window_stats(spark, path, 1, exact=True).inputFiles())
        stored = {tuple(r) for r in store.stored_manifest(spark, path).drop("users").collect()}
        assert stored == {tuple(r) for r in store.manifest(rows).drop("users").collect()}
    for bad in (None, 0):
        with pytest.raises(ValueError, match="project"):
            query.stored_window_stats(spark, path, bad)
    with pytest.raises(ValueError, match="hours"):
        query.stored_window_stats(spark, path, 1, width=HOUR // 2)


def test_retention(spark):
    rows = [(s, 10, s * 100, s * 10) for s in range(1, 7)]
    segments = spark.createDataFrame(rows, "segment bigint, bytes bigint, newest_ns bigint, end_offset bigint")
    gone = lambda **k: sorted(r["segment"] for r in store.expired(segments, now_ns=600, **k).collect())
    assert gone(max_bytes=35) == [1, 2, 3] and gone(max_age_ns=350) == [1, 2] and gone() == []
    assert gone(max_bytes=1, min_offset=20) == [1, 2] and gone(max_bytes=1) == [1, 2, 3, 4, 5]


def replay(hits, commands):
    """One project after the other, one row at a time."""
    live, out = {}, {}
    rows = sorted([(h[0], 1, h) for h in hits] + [(c[0], 0, c) for c in commands])
    for seq, is_hit, r in rows:
        p = r[1]
        if is_hit:
            f, level, seen = r[2], r[5], r[6]
            if (p, f) not in live:
                live[p, f] = {"status": "unresolved", "n": 1, "into": None, "last": seen, "level": level}
                out[p, seq] = (f, True, False, 1, "unresolved")
                continue
            t = live[p, f]["into"] or f
            i = live[p, t]
            back = i["status"] == "resolved"
            i.update(status="regressed" if back else i["status"], n=i["n"] + 1, last=max(i["last"], seen), level=level)
            out[p, seq] = (t, False, back, i["n"], i["status"])
            continue
        _, _, kind, f, target, sources, status = r
        if kind == "status" and status in issues.SETTABLE and (p, f) in live:
            live[p, f]["status"] = status
        elif kind == "split" and live.get((p, f), {}).get("into"):
            live[p, f].update(into=None, status="unresolved")
        elif kind == "merge" and (p, target) in live and not live[p, target]["into"] and all((p, s) in live and s != target for s in sources):
            for s in sources:
                live[p, target]["n"] += live[p, s]["n"]
                for (q, _), i in live.items():
                    if q == p and i["into"] == s:
                        i["into"] = target
                live[p, s]["into"] = target
    return out, live


def random_log():
    rng = random.Random(3)
    names = "abcdef"
    hits = [(s, rng.randint(1, 3), rng.choice(names), "b", f"t{s}", rng.choice(["error", "info"]), rng.randint(1, 999)) for s in range(0, 1200, 2)]
    commands = []
    for s in range(1, 1200, 14):
        p, kind = rng.randint(1, 3), rng.choice(["status", "status", "merge", "merge", "split"])
        sources = rng.sample(names, rng.randint(1, 2)) if kind == "merge" else None
        commands.append((s, p, kind, rng.choice(names), rng.choice(names) if kind == "merge" else None, sources, rng.choice([*issues.STATUSES]) if kind == "status" else None))
    return hits, commands


def test_timeline_equals_replay(spark):
    hits, commands = random_log()
    h, c = spark.createDataFrame(hits, HIT), spark.createDataFrame(commands, COMMAND)
    expected, live = replay(hits, commands)
    found = {(r["project_id"], r["arrival_seq"]): (r["target"], r["is_new"], r["regressed"], r["times_seen"], r["status"]) for r in issues.timeline(h, c).collect()}
    assert found == expected
    now = {(r["project_id"], r["fingerprint"]): (r["status"], r["times_seen"], r["merged_into"], r["last_seen"], r["level"]) for r in issues.current_issues(h, c).collect()}
    assert now == {k: (i["status"], i["n"], i["into"], i["last"], i["level"]) for k, i in live.items()}


def test_merged_and_split_ten_thousand_times(spark):
    n = 10_000
    commands = [(10 * k + (5 if kind == "merge" else 8), 1, kind, None if kind == "merge" else "a", "b" if kind == "merge" else None, ["a"] if kind == "merge" else None, None) for k in range(1, n) for kind in ("merge", "split")]
    hits = [(s, 1, f, "x", "t", "error", s) for s, f in ((0, "a"), (1, "b"))] + [(s, 1, "a", "x", "t", "error", s) for s in range(10, 10 * n, 3) if s % 10 not in (5, 8)]
    line = issues.timeline(spark.createDataFrame(hits, HIT), spark.createDataFrame(commands, COMMAND)).select("arrival_seq", "target").collect()
    assert len(line) == len(hits)
    assert all(r["target"] == ("b" if 5 < r["arrival_seq"] % 10 < 8 and r["arrival_seq"] > 10 or r["arrival_seq"] == 1 else "a") for r in line)


def test_running_values_over_slices(spark):
    from faultgrain.functions.ordered import running

    rows = spark.createDataFrame([(s % 2, s, s if s % 5 == 0 else None) for s in range(40)], "k int, s bigint, v bigint")
    found = running(rows, ["k"], "s", {"n": F.lit(1)}, {"last": F.col("v")}, width=7).collect()
    for r in found:
        assert r["n"] == r["s"] // 2 + 1
        assert r["last"] == max((x for x in range(r["s"]) if x % 2 == r["k"] and x % 5 == 0), default=None)


def test_search():
    assert issues.parse_search('is:resolved level:error release:"1.2 beta" USER.ID:u1 boom now') == {"status": "resolved", "level": "error", "release": "1.2 beta", "user": "u1", "text": "boom now"}
    assert issues.parse_search("") == {} and issues.parse_search("just text") == {"text": "just text"}
    for bad in ("is:open", "colour:red", "http://x"):
        with pytest.raises(ValueError, match="unknown"):
            issues.parse_search(bad)
    for bad in ([], ["t"], ["x"] * 101):
        with pytest.raises(ValueError, match="sources"):
            issues.merge_issues(1, "t", bad, 1)
    with pytest.raises(ValueError, match="set"):
        issues.set_status(1, "a", "regressed", 1)


def test_alerts(spark):
    at = datetime(2026, 1, 1)
    rows = [(n, 1, "i", at + timedelta(seconds=s), "t", "error", "regressed", n, n == 1, n > 1) for n, s in enumerate((0, 10, 299, 300, 320, 700), 1)]
    rows.append((9, 1, "other", at, "t", "error", "regressed", 2, False, True))
    activity = spark.createDataFrame(rows, "arrival_seq bigint, project_id bigint, issue string, ts timestamp, title string, level string, status string, times_seen bigint, is_new boolean, regressed boolean")
    rules = spark.createDataFrame([(1, 1, "new", "new_issue", 0, True), (2, 1, "back", "regression", 0, True), (3, 1, "often", "frequency", 3, True), (4, 1, "off", "new_issue", 0, False), (5, 2, "far", "new_issue", 0, True), (6, 1, "zero", "frequency", 0, True)], "id bigint, project_id bigint, name string, condition string, threshold bigint, enabled boolean")
    fired = sorted((r["rule_id"], r["issue"], r["arrival_seq"]) for r in alerts.firings(activity, rules).collect())
    assert fired == [(1, "i", 1), (2, "i", 2), (2, "i", 5), (2, "i", 6), (2, "other", 9), (3, "i", 3)]
    for bad in (("", "new_issue", "u"), ("n", "never", "u"), ("n", "frequency", "")):
        with pytest.raises(ValueError, match="rule"):
            alerts.check_rule(*bad)


def test_quota(spark):
    times = [0] * 6 + [500_000_000] * 6 + [20 * 10**9]
    rows = [(p, n, START + ns) for p in (1, 2) for n, ns in enumerate(times)]
    limits = spark.createDataFrame([(1, 10.0, 5.0)], "project_id bigint, per_second double, burst double")
    found = quota.admit(spark.createDataFrame(rows, "project_id bigint, arrival_seq bigint, ts_ns bigint"), limits).collect()
    admitted = {p: [r["arrival_seq"] for r in sorted(found, key=lambda r: r["arrival_seq"]) if r["project_id"] == p and r["admitted"]] for p in (1, 2)}
    assert admitted == {1: [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 12], 2: list(range(13))}
    assert all(r["retry_after_ns"] >= 10**9 for r in found if not r["admitted"])


def plain_firings(times, wait):
    last, out = None, []
    for n, at in enumerate(times):
        if last is None or at - last >= wait:
            last = at
            out.append(n)
    return out, last


def test_cooldown_steps_of_a_slice():
    """The step function of any stretch of matches equals walking it, from any last firing."""
    rng = random.Random(4)
    for _ in range(400):
        wait = rng.choice((1, 5, 20))
        times = sorted(rng.randrange(50, rng.choice((60, 150))) for _ in range(rng.randint(1, 30)))
        piece = alerts.CooldownSlice(wait)
        for at in times:
            piece.see(at)
        steps = piece.steps()
        for last in (None, *range(0, min(times) + 1)):
            now = last
            for at in times:
                if now is None or at - now >= wait:
                    now = at
            assert alerts.after(last, *steps) == now
        assert len(steps[1]) <= wait + 1


@pytest.mark.parametrize("slice_rows", [1, 7, 100_000])
def test_cooldown_in_slices(spark, slice_rows):
    rng = random.Random(9)
    rows = [(1, 1, "hot", n, datetime(2026, 1, 1) + timedelta(milliseconds=rng.randrange(600_000))) for n in range(1500)]
    rows += [(k % 3, 2, f"i{k % 4}", 2000 + k, datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(4000))) for k in range(300)]
    df = spark.createDataFrame(rows, "rule_id bigint, project_id bigint, issue string, arrival_seq bigint, ts timestamp")
    expected = set()
    for key in {r[:3] for r in rows}:
        own = sorted((r[4], r[3]) for r in rows if r[:3] == key)
        start = own[0][0]
        expected |= {own[k][1] for k in plain_firings([(at - start) // timedelta(microseconds=1) for at, _ in own], 7_000_000)[0]}
    fired = alerts.cool_down(df, 7, slice_rows)
    assert {r["arrival_seq"] for r in fired.collect()} == expected
    assert alerts.cool_down(df, 0).count() == len(rows)


@pytest.mark.parametrize("keys", [["issue"], ["issue", "_slice"]])
def test_keys_stay_together_behind_a_join(spark, keys):
    """A join that is planned with a shuffle and becomes a broadcast one as it runs; cooldowns and quotas walk rows behind it."""
    changed = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "100KB", "adaptive.coalescePartitions.enabled": "false"}
    for name, value in changed.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        rows = spark.range(0, 40000, 1, 4).select("id", (F.col("id") % 3).alias("issue"), (F.col("id") % 2).alias("_slice"))
        begun = rows.join(rows.groupBy(*keys).agg(F.min("id").alias("entry")), keys)
        found = dealt(begun, keys, "id").mapInPandas(lambda batches: (b[["issue", "_slice"]].drop_duplicates() for b in batches), "issue bigint, _slice bigint")
        tasks = found.select(*keys, F.spark_partition_id().alias("task")).distinct().collect()
    finally:
        for name in changed:
            spark.conf.unset(f"spark.sql.{name}")
    assert len(tasks) == len({r[:-1] for r in tasks}) == 3 * len(keys)


def test_quota_function_of_a_slice():
    """The function of any stretch of requests equals walking it, from any content of the bucket."""
    rng = random.Random(6)
    token = quota.TOKEN
    for _ in range(300):
        rate, full = rng.choice((0, 1, 3_000, 250_000_000)), rng.choice((token // 2, token, 3 * token, 3 * token + 12345, 40 * token))
        gaps = rng.choice(([0], [0, 1], [0, token // 7 // max(rate, 1)], [0, 1000, token // max(rate, 1) // 3, token // max(rate, 1)], [token // max(rate, 1), 5 * token // max(rate, 1), 0]))
        times, at = [], 10**9
        for _ in range(rng.randint(1, 60)):
            times.append(at)
            at += rng.choice(gaps)
        piece = quota.BucketSlice(rate, full, times[0])
        for at in times:
            piece.see(at)
        state = json.loads(piece.state())
        for tokens in {0, full, *(rng.randrange(full + 1) for _ in range(30)), *(min(full, k * token + d) for k in range(4) for d in (0, 1, token - 1))}:
            bucket = quota.Bucket(tokens, times[0])
            for at in times:
                bucket.admit(at, rate, full)
            assert quota.after(tokens, state) == bucket.tokens
        assert len(state[-1]) <= (6 if full >= 3 * token else len(times) + 2)


def test_quota_function_takes_few_steps():
    """A bucket of one token under a storm has as many pieces as requests in a refill; each request still costs little."""
    piece = quota.BucketSlice(10**6, quota.TOKEN, 0)  # a token takes a second, requests come every 50 microseconds
    began = time.perf_counter()
    for k in range(100_000):
        piece.see(k * 50_000)
    assert len(piece.pieces) > 10_000 and time.perf_counter() - began < 5


@pytest.mark.parametrize("slice_rows", [1, 40, 100_000])
def test_quota_in_slices(spark, slice_rows):
    rng = random.Random(8)
    rows = [(1, n, START + 10 * n * 10**7 + rng.randrange(10**7)) for n in range(1200)]  # always busy: 10 a second, 3 are admitted
    rows += [(2, 5000 + n, START + rng.randrange(200) * 10**9) for n in range(400)] + [(3, 9000 + n, START + n) for n in range(50)]
    limits = spark.createDataFrame([(1, 3.3, 20.0), (2, 0.7, 2.5)], "project_id bigint, per_second double, burst double")
    found = quota.admit(spark.createDataFrame(rows, "project_id bigint, arrival_seq bigint, ts_ns bigint"), limits, slice_rows)
    expected = {}
    for project, limit in ((1, (3.3, 20.0)), (2, (0.7, 2.5)), (3, (quota.PER_SECOND, quota.BURST))):
        rate, full = quota.units(*limit)
        own = sorted((at, n) for p, n, at in rows if p == project)
        bucket = quota.Bucket(full, own[0][0])
        expected |= {n: bucket.admit(at, rate, full) for at, n in own}
    assert {r["arrival_seq"]: (r["admitted"], r["retry_after_ns"]) for r in found.collect()} == expected
    assert 300 < sum(ok for n, (ok, _) in expected.items() if n < 5000) < 500


def test_no_row_of_another_project(spark):
    table = events(spark, 4, 1, 20)
    issue = table.select("project_id", "fingerprint", F.lit("unresolved").alias("status"), "level", F.lit("t").alias("title"), F.lit(None).cast("string").alias("merged_into"), F.col("ts_ns").alias("last_seen"))
    projects = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "id bigint, org_id bigint")
    views = [query.scan(table, 2), query.matching(table, 2, level="error"), issues.search_issues(issue, table, 2, release="1.1.0"), issues.filter_issues(issue, 2)]
    assert all({r["project_id"] for r in v.select("project_id").distinct().collect()} == {2} for v in views)
    seen = access.scoped_view(table, projects, 1, access.ROLES["read_only"])
    assert {r["project_id"] for r in seen.collect()} == {1, 2} and seen.where("payload is not null").count() == 0
    assert access.scoped_view(table, projects, 1, access.ROLES["member"]).where("payload is null").count() == 0
    assert access.scoped_view(table, projects, 1, access.ROLES["billing"]).count() == 0
    users = spark.createDataFrame([(1, 1, "member"), (2, 1, "guest")], "user_id bigint, org_id bigint, role string")
    tokens = spark.createDataFrame([(1, 1, ["issue:read", "org:write"], 0, False), (2, 1, [], 99, False), (3, 1, [], 5, False), (4, 1, [], 0, True), (5, 2, ["org:read"], 0, False)], "id bigint, user_id bigint, permissions array<string>, expires_at bigint, revoked boolean")
    found = {r["token_id"]: r["permissions"] for r in access.effective_permissions(users, tokens, 50).collect()}
    assert found == {1: ["issue:read"], 2: sorted(access.ROLES["member"]), 5: []}
