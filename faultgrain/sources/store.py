"""The event table: write, read, compact, manifest, rollups, retention.

The files of an append lie in a commit folder of their own and count once the
log of versions names them (``versions``). Inside, a directory per event_date
and project_bucket, or with ``by_hour`` per project_id and hour. A bucket's name
says of how many it is (``3-64``), so that a small day has one directory and a
large one up to 64, and a project's rows are in one of seven directories of its
day. Files are sorted by project and time; compacted files of large days have
Bloom filters.

Next to the rows, under ``_rollup`` and ``_users``, every commit holds partial
aggregates of them: per project and hour the rows, their time range and a sketch
of their users, and counts by value of each tag; per project and day the users
themselves. They merge by sums and unions, which is what compaction does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import HOUR_NS, bucket_start, hour_key
from ..schema import EVENT, SCHEMA_VERSION
from . import versions

MOST_BUCKETS = 64
BUCKET_ROWS = 4_000_000
BLOOM_ROWS = 1_000_000
BLOOM_BYTES = 128 << 10
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
BLOOM_COLUMNS = ("fingerprint", "release", "user_id")
TAGS = ("level", "release", "environment", "fingerprint")
BY_DATE, BY_HOUR = ("event_date", "project_bucket"), ("project_id", "hour")
ROLLUP = "project_id bigint, start bigint, tag string, key string, count bigint, low bigint, high bigint, users binary"
USERS = "project_id bigint, day date, user_id string, count bigint"
ROLLUP_FOLDER, USERS_FOLDER = "_rollup", "_users"


#: How the error about a row of a schema version that this code does not know begins.
UNKNOWN_VERSION = "unknown schema version"


def project_bucket(project_id: Column, buckets: Column | int) -> Column:
    """The name of a project's bucket among ``buckets``."""
    n = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.concat_ws("-", F.pmod(F.xxhash64(project_id), n).cast("string"), n.cast("string"))


def event_date(ts_ns: Column) -> Column:
    return F.to_date(F.timestamp_seconds(F.floor(ts_ns / HOUR_NS) * 3600))


def _save(rows: DataFrame, to: str, keys: tuple[str, ...], order: tuple[str, ...], bloom: bool = False) -> None:
    # Partitions by size: many small directories to a task, a large directory to many.
    out = rows.hint("rebalance", *(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    writer = out.write.mode("overwrite").partitionBy(*keys).option("compression", "zstd")
    if bloom:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
        for column in BLOOM_COLUMNS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(to)


def _schema(directory: str) -> tuple[tuple[str, ...], str]:
    """Partition columns and schema of the rows of a table with such directories."""
    return (BY_HOUR, f"{EVENT}, hour int") if directory.startswith("project_id=") else (BY_DATE, f"{EVENT}, event_date date, project_bucket string")


def _beside(schema: str, keys: tuple[str, ...]) -> str:
    return schema if keys == BY_HOUR else f"{schema}, event_date date"


def partial_counts(events: DataFrame) -> DataFrame:
    """ROLLUP rows of events: tag 'total' with time range and sketch, and a count per value of each tag."""
    start = bucket_start(F.col("ts_ns"), HOUR_NS).alias("start")
    values = events.groupBy("project_id", start, *TAGS).agg(F.count("*").alias("count"))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("key")) for t in TAGS)))
    none = F.lit(None)
    tags = values.select("project_id", "start", "count", each.alias("x")).where("x.key <> ''").groupBy("project_id", "start", "x.tag", "x.key").agg(F.sum("count").alias("count"))
    user = F.when(F.col("user_id") != "", F.col("user_id"))
    total = events.groupBy("project_id", start).agg(F.count("*").alias("count"), F.min("ts_ns").alias("low"), F.max("ts_ns").alias("high"), F.hll_sketch_agg(user, 12).alias("users"))
    total = total.select("project_id", "start", F.lit("total").alias("tag"), F.lit("").alias("key"), "count", "low", "high", "users")
    return total.unionByName(tags.select("*", none.cast("bigint").alias("low"), none.cast("bigint").alias("high"), none.cast("binary").alias("users")))


def day_users(events: DataFrame) -> DataFrame:
    """USERS rows of events; rows without a user count under ''."""
    return events.groupBy("project_id", event_date(F.col("ts_ns")).alias("day"), "user_id").agg(F.count("*").alias("count"))


def merged(partial: DataFrame) -> DataFrame:
    """ROLLUP rows with one row for each (project_id, start, tag, key)."""
    is_total = F.col("tag") == "total"
    rows = partial.groupBy("project_id", "start", "tag", "key").agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("users").alias("users"))
    return rows.withColumn("users", F.when(is_total, F.col("users")))


def _commit_files(spark: SparkSession, path: str, own: str, rows: DataFrame, keys: tuple[str, ...], bloom: bool, folded: tuple[DataFrame, DataFrame] | None = None) -> dict[str, int]:
    """Write rows and partial aggregates of a commit; the rows of each directory. ``folded`` holds aggregates that are known."""
    _save(rows, f"{path}/commit={own}", keys, ("project_id", "ts_ns"), bloom)
    kind = _schema(f"{keys[0]}=")[1]
    if not folded:
        back = spark.read.schema(kind).parquet(f"{path}/commit={own}").select("project_id", "ts_ns", *TAGS, "user_id")
        folded = partial_counts(back), day_users(back)
    first = keys[0]
    dated = lambda df, day: df.withColumn(first, day) if keys == BY_DATE else df
    more = () if keys == BY_HOUR else ("project_id",)
    jobs = [
        lambda: _save(dated(folded[0], event_date(F.col("start"))), f"{path}/{ROLLUP_FOLDER}/commit={own}", (first,), ("tag", *more, "start")),
        lambda: _save(dated(folded[1], F.col("day")), f"{path}/{USERS_FOLDER}/commit={own}", (first,), (*more, "user_id")),
    ]
    with ThreadPoolExecutor(len(jobs)) as pool:  # two small jobs at once
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()
    totals = spark.read.schema(_beside(ROLLUP, keys)).parquet(f"{path}/{ROLLUP_FOLDER}/commit={own}").where("tag = 'total'").groupBy(first).agg(F.sum("count").alias("n"))
    return {f"{first}={r[first]}": r["n"] for r in totals.collect()}  # a row for each directory


def write_events(events: DataFrame, path: str, *, by_hour: bool = False, buckets: int = 1, writer: str = "", batch: int = 0) -> versions.Version:
    """Append events; ``buckets`` (a power of two up to 64) splits the projects of a day. With a ``writer`` a batch number counts once."""
    if buckets not in (1 << k for k in range(7)):
        raise ValueError(f"buckets must be a power of two up to {MOST_BUCKETS}")
    spark, rows = events.sparkSession, events.select(*COLUMNS)
    if by_hour:
        keys, rows = BY_HOUR, rows.withColumn("hour", hour_key(F.col("ts_ns")))
    else:
        keys, rows = BY_DATE, rows.withColumns({"event_date": event_date(F.col("ts_ns")), "project_bucket": project_bucket(F.col("project_id"), buckets)})
    return versions.append(spark, path, lambda own: _commit_files(spark, path, own, rows, keys, bloom=False), writer=writer, batch=batch)


def read_events(spark: SparkSession, path: str, *, check: bool = True, version: versions.Version | None = None, since: int = 0, until: int = 0) -> DataFrame:
    """The event table as of its last version, or of ``version``; later commits are seen by reading again.

    An inclusive time range leaves the directories of other days unlisted.
    Rows of an unknown schema version fail the query that meets them, so that
    opening the table reads nothing and a scan checks only what it reads.
    """
    version = version or versions.latest(spark, path)
    pairs = version.pairs(_days(since, until))
    keys, schema = _schema(next((d for _, d in version.pairs()), ""))
    table = versions.read(spark, path, schema, pairs=pairs).select(*COLUMNS, *(k for k in keys if k not in COLUMNS))
    if not check:
        return table
    known = F.col("schema_version").eqNullSafe(SCHEMA_VERSION)
    message = F.concat(F.lit(f"{UNKNOWN_VERSION} "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))
    return table.where(F.when(known, True).otherwise(F.raise_error(message).cast("boolean")))


def day_of(ts_ns: int) -> str:
    """The UTC day of a time, as directories name it."""
    return datetime.fromtimestamp(ts_ns // 1_000_000_000, UTC).strftime("%Y-%m-%d")


def _days(since: int, until: int) -> Callable[[str], bool]:
    """Whether a directory may hold rows of a time range (0: no bound)."""
    low, high = (day_of(since) if since else ""), (day_of(until) if until else "9999-99-99")
    return lambda name: not name.startswith("event_date=") or low <= name.removeprefix("event_date=") <= high


def partition_predicate(table: DataFrame, project_id: int, since: int | None = None, until: int | None = None) -> Column:
    """What the table's directory columns say of a project and an inclusive time range."""
    found = F.col("project_id") == project_id
    low, high = (None if x is None else F.lit(x) for x in (since, until))
    if "hour" in table.columns:
        column, key = F.col("hour"), hour_key
    elif "event_date" in table.columns:
        own = F.lit(project_id).cast("bigint")
        found = found & F.col("project_bucket").isin(*(project_bucket(own, 1 << k) for k in range(7)))
        column, key = F.col("event_date"), event_date
    else:
        return found
    if low is not None:
        found = found & (column >= key(low))
    if high is not None:
        found = found & (column <= key(high))
    return found


def union_tiers(hot: DataFrame, warm: DataFrame) -> DataFrame:
    """Rows that are not written yet together with stored ones; the first of a repeated event id stays."""
    both = warm.select(*COLUMNS, F.lit(0).alias("_tier")).unionByName(hot.select(*COLUMNS, F.lit(1).alias("_tier")))
    named = both.where("event_id <> ''")
    order = Window.partitionBy("project_id", "event_id").orderBy("_tier", "ts_ns")
    first = named.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.unionByName(both.where("event_id = ''")).drop("_tier")


def compact(spark: SparkSession, path: str, pick: Callable[[str], bool] | None = None) -> versions.Version:
    """Rewrite directories that several commits share as few sorted files, and fold their aggregates.

    ``pick`` chooses among them by name (``event_date=2026-07-28``). One commit of
    the log puts the new folder in the place of those that were read, so readers
    see the table before or after, appends meanwhile stay, and a job that dies
    or comes second changes nothing. A day gets a bucket for every BUCKET_ROWS rows.
    """
    now = versions.latest(spark, path)
    held: dict[str, list[str]] = {}
    for c, d in now.pairs(pick):
        held.setdefault(d, []).append(c)
    old = [(c, d) for d, commits in held.items() if len(commits) > 1 for c in commits]
    if not old:
        return now
    keys, schema = _schema(old[0][1])
    rows = versions.read(spark, path, schema, pairs=old).select(*COLUMNS, *(k for k in keys if k not in COLUMNS))
    sizes: dict[str, int] = {}
    for c, d in old:
        sizes[d] = sizes.get(d, 0) + max(now.live[c][d], 0)
    if keys == BY_DATE:
        split = {d.removeprefix("event_date="): min(MOST_BUCKETS, 1 << max(0, (n - 1) // BUCKET_ROWS).bit_length()) for d, n in sizes.items()}
        buckets = F.lit(1)
        for n in set(split.values()) - {1}:
            buckets = F.when(F.col("event_date").cast("string").isin(*(d for d, k in split.items() if k == n)), n).otherwise(buckets)
        rows = rows.withColumn("project_bucket", project_bucket(F.col("project_id"), buckets))
    folded = merged(versions.read(spark, path, _beside(ROLLUP, keys), pairs=old, inside=ROLLUP_FOLDER))
    users = versions.read(spark, path, _beside(USERS, keys), pairs=old, inside=USERS_FOLDER).groupBy("project_id", "day", "user_id").agg(F.sum("count").alias("count"))
    return versions.replace(spark, path, old, lambda own: _commit_files(spark, path, own, rows, keys, max(sizes.values()) > BLOOM_ROWS, (folded, users)))


def rollup(spark: SparkSession, path: str, *, version: versions.Version | None = None, since: int = 0, until: int = 0) -> DataFrame:
    """Partial aggregates of the table's rows, ROLLUP rows, of days that a time range touches; several of a key where commits share a day."""
    version = version or versions.latest(spark, path)
    pairs = version.pairs(_days(since, until))
    keys, _ = _schema(next((d for _, d in version.pairs()), ""))
    return versions.read(spark, path, _beside(ROLLUP, keys), pairs=pairs, inside=ROLLUP_FOLDER)


def users_by_day(spark: SparkSession, path: str, *, version: versions.Version | None = None, since: int = 0, until: int = 0) -> DataFrame:
    """USERS rows of days that a time range touches."""
    version = version or versions.latest(spark, path)
    pairs = version.pairs(_days(since, until))
    keys, _ = _schema(next((d for _, d in version.pairs()), ""))
    return versions.read(spark, path, _beside(USERS, keys), pairs=pairs, inside=USERS_FOLDER).where("user_id <> ''")


def stored_manifest(spark: SparkSession, path: str, version: versions.Version | None = None) -> DataFrame:
    """``manifest`` of the stored table from what its commits wrote; no event is read."""
    rows = merged(rollup(spark, path, version=version).where("tag = 'total'"))
    return rows.select("project_id", hour_key(F.col("start")).alias("hour"), F.col("count").alias("rows"), F.col("low").alias("min_ts"), F.col("high").alias("max_ts"), "users")


def drop_before(spark: SparkSession, path: str, day: str) -> list[str]:
    """Take whole days before ``day`` (``2026-07-28``) out of a table by date; the directories that went. ``vacuum`` frees their space."""
    return versions.drop(spark, path, lambda name: name.startswith("event_date=") and name.removeprefix("event_date=") < day)


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 86400) -> int:
    """Delete what only versions older than ``keep_seconds`` name."""
    return versions.vacuum(spark, path, keep_seconds, (ROLLUP_FOLDER, USERS_FOLDER))


def manifest(events: DataFrame) -> DataFrame:
    """Per (project_id, hour): rows, time range and a sketch of the users."""
    user = F.when(F.col("user_id") != "", F.col("user_id"))
    return events.groupBy("project_id", hour_key(F.col("ts_ns")).alias("hour")).agg(
        F.count("*").alias("rows"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.hll_sketch_agg(user, 12).alias("users")
    )


def expired(segments: DataFrame, *, now_ns: int, max_bytes: int = 0, max_age_ns: int = 0, min_offset: int | None = None) -> DataFrame:
    """Of ``segments(segment, bytes, newest_ns, end_offset)`` in order of segment, those to drop whole.

    Oldest first: a segment goes while the rest is over ``max_bytes`` or its
    newest row is older than ``max_age_ns`` (0: no such bound), as long as every
    segment before it goes too. The last one and those that end beyond
    ``min_offset`` stay.
    """
    # One row a segment; a running sum over them in order.
    after = Window.orderBy(F.desc("segment"))
    upto = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("bytes").over(after)
    over = (left > max_bytes) if max_bytes > 0 else F.lit(False)
    old = (F.lit(now_ns) - F.col("newest_ns") > max_age_ns) if max_age_ns > 0 else F.lit(False)
    free = (F.col("end_offset") <= min_offset) if min_offset is not None else F.lit(True)
    last = F.row_number().over(after) == 1
    goes = segments.withColumn("_goes", free & ~last & (over | old))
    return goes.withColumn("_all", F.bool_and("_goes").over(upto)).where("_all").drop("_goes", "_all")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under the checkpoint folder, or local in a local session."""
    import tempfile

    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made inside are deleted at the end; for micro-batches, whose results are written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(token)
        for path in made:
            versions.delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder that all executors see, and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
