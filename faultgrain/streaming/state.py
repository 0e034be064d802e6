"""Stateful processors: issues, alert cooldowns and quotas on streams.

Each key's state is a few values, kept in the state store (use the RocksDB
provider). Rows of a batch are taken in arrival order. Results equal those of
the batch operators on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import COOLDOWN_SECONDS, match_rules, payload
from ..operators.quota import Bucket, limited

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_AHEAD = 86_400_000_000


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(columns), kind="stable")


class _Issues(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("issue", "times_seen bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, status = self.state.get() if self.state.exists() else (0, "")
        out = []
        for r in _in_order(rows, "arrival_seq").itertuples(index=False):
            if r.row == "status":
                if status:
                    status = r.set_status
            elif r.row == "transfer":
                seen += int(r.weight)
            else:
                seen += 1
                is_new, regressed = not status, status == "resolved"
                status = "unresolved" if is_new else "regressed" if regressed else status
                out.append((key[0], key[1], int(r.arrival_seq), is_new, regressed, seen, status))
        self.state.update((seen, status))
        yield pd.DataFrame(out, columns=["project_id", "target", "arrival_seq", "is_new", "regressed", "times_seen", "status"])

    def close(self) -> None:
        pass


def issue_outcomes(rows: DataFrame) -> DataFrame:
    """Outcome of each hit of a stream of rows (project_id, target, arrival_seq, row, weight, set_status).

    ``row`` is hit, status or transfer. Hits are routed to their merge target
    before they come here, and a merge sends its source's count as a transfer row.
    """
    return rows.groupBy("project_id", "target").transformWithStateInPandas(
        _Issues(), "project_id bigint, target string, arrival_seq bigint, is_new boolean, regressed boolean, times_seen bigint, status string", "Append", "None"
    )


class _Cooldown(StatefulProcessor):
    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in _in_order(rows, "at", "arrival_seq").itertuples(index=False):
            if last is None or r.at - last >= self.micros:
                last = int(r.at)
                out.append((key[0], key[1], key[2], int(r.arrival_seq), int(r.at), r.payload))
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer(_later(last + self.micros + _AHEAD, timerValues))
        yield pd.DataFrame(out, columns=["rule_id", "project_id", "issue", "arrival_seq", "at", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A firing since has a timer of its own.
        if self.last.exists() and self.last.get()[0] + self.micros + _AHEAD <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        yield pd.DataFrame([], columns=["rule_id", "project_id", "issue", "arrival_seq", "at", "payload"])

    def close(self) -> None:
        pass


def _later(micros: int, timerValues) -> int:
    """A time for a timer, in ms: not before ``micros``, nor before the watermark."""
    return max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1)


def alert_firings(activity: DataFrame, rules: DataFrame, seconds: float = COOLDOWN_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Firings of a stream of activity; ``rules`` is a static table.

    Once the watermark of ts has passed a cooldown's end, its state is gone; rows later than the watermark are left out.
    """
    # A watermark begins at the epoch; the clock is ahead, so that rows of that instant are not late.
    clocked = activity.withColumn("clock", F.timestamp_micros(F.unix_micros("ts") + _AHEAD)).withWatermark("clock", delay)
    found = match_rules(clocked, rules).withColumn("payload", payload()).withColumn("at", F.unix_micros("ts"))
    found = found.select("rule_id", "project_id", "issue", "arrival_seq", "clock", "at", "payload")
    return found.groupBy("rule_id", "project_id", "issue").transformWithStateInPandas(
        _Cooldown(int(seconds * 1_000_000)), "rule_id bigint, project_id bigint, issue string, arrival_seq bigint, at bigint, payload string", "Append", "EventTime"
    )


class _FirstArrivals(StatefulProcessor):
    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[1].startswith("id-"):
            yield from (part.drop(columns=["key_project", "key_id"]) for part in rows)
            return
        found = _in_order(rows, "arrival_seq", "item_no").drop(columns=["key_project", "key_id"])
        # Timers run after a batch's rows.
        known = self.seen.exists() and self.seen.get()[0] + self.micros > timerValues.getCurrentWatermarkInMs() * 1000
        if not known:
            at = int(found["first_at"].iloc[0])
            self.seen.update((at,))
            self.handle.registerTimer(_later(at + self.micros, timerValues))
        yield found.assign(reason=[None if not known and k == 0 else "duplicate" for k in range(len(found))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # An arrival since has a timer of its own.
        if self.seen.exists() and self.seen.get()[0] + self.micros <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_arrivals(rows: DataFrame, hold: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """A stream of classified rows with reason duplicate for an id that came before; an empty id never repeats.

    An id is forgotten when the watermark of received_at has passed ``hold`` after its first arrival.
    """
    spark = rows.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp '1970-01-01' + interval {hold}) - unix_micros(timestamp '1970-01-01')").collect()[0][0]
    own = F.concat_ws("-", F.lit("row"), "arrival_seq", "item_no")
    key = F.when(F.col("reason").isNull() & (F.col("event_id") != ""), F.concat(F.lit("id-"), "event_id")).otherwise(own)
    # Nullable numbers go through pandas as text.
    sent = rows.withColumns({"key_project": F.col("project_id"), "key_id": key, "first_at": F.unix_micros("received_at"), "ts_ns": F.col("ts_ns").cast("string")}).withWatermark("received_at", delay)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name not in ("key_project", "key_id"))
    out = sent.groupBy("key_project", "key_id").transformWithStateInPandas(_FirstArrivals(micros), kinds, "Append", "EventTime")
    return out.withColumn("ts_ns", F.col("ts_ns").cast("bigint")).drop("first_at")


class _Quota(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens string, last_ns bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.bucket.get() if self.bucket.exists() else None
        bucket = Bucket(int(held[0]), held[1]) if held else None
        out = []
        for r in _in_order(rows, "ts_ns", "arrival_seq").itertuples(index=False):
            bucket = bucket or Bucket(int(r.full), int(r.ts_ns))
            ok, wait = bucket.admit(int(r.ts_ns), int(r.rate), int(r.full))
            out.append((key[0], int(r.arrival_seq), int(r.ts_ns), ok, wait, None if ok else "overloaded"))
        if bucket:
            self.bucket.update((str(bucket.tokens), bucket.last_ns))
        yield pd.DataFrame(out, columns=["project_id", "arrival_seq", "ts_ns", "admitted", "retry_after_ns", "reason"])

    def close(self) -> None:
        pass


def admissions(arrivals: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Admission of a stream of arrivals (project_id, arrival_seq, ts_ns); rejected rows get reason overloaded."""
    return limited(arrivals, limits).groupBy("project_id").transformWithStateInPandas(
        _Quota(), "project_id bigint, arrival_seq bigint, ts_ns bigint, admitted boolean, retry_after_ns bigint, reason string", "Append", "None"
    )
