"""Scans and window statistics over events of one project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import HOUR_NS, bucket_start, hour_key
from ..sources import store, versions
from ..sources.store import TAGS, partition_predicate

TOP, TOP_MOST = 10, 50
SCAN_LIMIT = 10_000


def event_predicate(
    *, level: str = "", fingerprint: str = "", release: str = "", environment: str = "", user_id: str = "", since: int = 0, until: int = 0
) -> Column:
    """Equality on tags and an inclusive time range in nanoseconds; '' and 0 mean no constraint."""
    out = F.lit(True)
    for name, value in (("level", level), ("fingerprint", fingerprint), ("release", release), ("environment", environment), ("user_id", user_id)):
        if value:
            out = out & (F.col(name) == value)
    if since:
        out = out & (F.col("ts_ns") >= since)
    if until:
        out = out & (F.col("ts_ns") <= until)
    return out


def scope(events: DataFrame, project_id: int | None, since: int = 0, until: int = 0) -> DataFrame:
    """The project's events; a query without a project is an error. Directory columns prune files."""
    if not project_id:
        raise ValueError("a project is required")
    return events.where(partition_predicate(events, project_id, since or None, until or None))


def matching(events: DataFrame, project_id: int | None, **filters) -> DataFrame:
    """Scope and predicate together."""
    return scope(events, project_id, filters.get("since", 0), filters.get("until", 0)).where(event_predicate(**filters))


def lite(events: DataFrame) -> DataFrame:
    """The columns that statistics need, without payload and message."""
    return events.select("event_id", "project_id", "ts_ns", *TAGS, "user_id")


def scan(events: DataFrame, project_id: int | None, limit: int = 0, **filters) -> DataFrame:
    """Newest matching events; at most ``limit`` (10 000 if not positive)."""
    return matching(events, project_id, **filters).orderBy(F.desc("ts_ns"), "event_id").limit(limit if limit > 0 else SCAN_LIMIT)


def raw_page(events: DataFrame) -> DataFrame:
    """Events with their payload as JSON, null where it is none."""
    return events.withColumn("payload", F.try_parse_json(F.decode("payload", "UTF-8")))


def bucket_counts(events: DataFrame, width: int = HOUR_NS, by: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy(*by, bucket_start(F.col("ts_ns"), width).alias("start")).agg(F.count("*").alias("count"))


def ordered_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy("start")


def top_values(events: DataFrame, n: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """(tag, key, count): the most frequent non-empty values of each tag, by count and then key."""
    n = n if 0 < n <= TOP_MOST else TOP
    pairs = events.select(*by, F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("key")) for t in TAGS))).alias("x"))
    counts = pairs.where("x.key <> ''").groupBy(*by, "x.tag", "x.key").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(*by, "tag").orderBy(F.desc("count"), "key"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def unique_users(events: DataFrame, exact: bool = False) -> DataFrame:
    """One row ``unique_users``; '' is no user."""
    user = F.when(F.col("user_id") != "", F.col("user_id"))
    count = F.count_distinct(user) if exact else F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(user, 12)), F.lit(0))
    return events.agg(count.alias("unique_users"))


def total(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total"))


def _stats_row(buckets: DataFrame, tops: DataFrame, users: DataFrame) -> DataFrame:
    """One row (total, buckets, top_by, unique_users) of (start, count), (tag, key, count) and (unique_users)."""
    pair = lambda *c: F.struct(*(F.col(x) for x in c))
    buckets = buckets.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(pair("start", "count"))).alias("buckets"))
    tops = tops.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "key", "count"))).alias("kv"))
    tops = tops.select("tag", F.transform("kv", lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"))).alias("kv"))
    tops = tops.agg(F.map_from_entries(F.collect_list(pair("tag", "kv"))).alias("top_by"))
    one = F.lit(1)
    return buckets.withColumn("_k", one).join(tops.withColumn("_k", one), "_k").join(users.withColumn("_k", one), "_k").drop("_k")


def window_stats(events: DataFrame, project_id: int | None, width: int = HOUR_NS, n: int = TOP, exact: bool = False, **filters) -> DataFrame:
    """One row (total, buckets, top_by, unique_users). Buckets and tag values are few; events are read once each."""
    found = lite(matching(events, project_id, **filters))
    return _stats_row(bucket_counts(found, width), top_values(found, n), unique_users(found, exact))


def _split(since: int, until: int, width: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(first, end of the last, edges) of the whole units in an inclusive range (0: no bound); edges are inclusive ranges of single rows.

    First or end is 0 where the range has no bound; first = end where no unit lies inside.
    """
    first = -(-since // width) * width
    end = (until + 1) // width * width if until else 0
    if until and end <= first:
        return 0, 0, [(since, until)]
    edges = []
    if since < first:
        edges.append((since, first - 1))
    if until and end <= until:
        edges.append((end, until))
    return first, end, edges


def _whole(table: DataFrame, column: Column, first: int, end: int) -> DataFrame:
    table = table.where(column >= first) if first else table
    return table.where(column < end) if end else table


def _edge_rows(spark: SparkSession, path: str, version: versions.Version, project_id: int, edges: list[tuple[int, int]]) -> DataFrame | None:
    """Stored events of the project in the edges; only the directories of their days are opened."""
    out = None
    for low, high in edges:
        rows = lite(matching(store.read_events(spark, path, version=version, since=low, until=high), project_id, since=low, until=high))
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_window_stats(spark: SparkSession, path: str, project_id: int | None, *, since: int = 0, until: int = 0, width: int = HOUR_NS, n: int = TOP, exact: bool = False) -> DataFrame:
    """``window_stats`` of a stored table from its partial aggregates: whole hours, and rows for the rest of the first and the last.

    ``width`` is a number of hours. Exact users come from the users of whole days
    and from rows of the days at the ends. Without bounds no event is read.
    """
    if not project_id:
        raise ValueError("a project is required")
    if width % HOUR_NS:
        raise ValueError("stored statistics are in hours")
    version = versions.latest(spark, path)
    first, end, edges = _split(since, until, HOUR_NS)
    rows = _edge_rows(spark, path, version, project_id, edges)
    hours = store.rollup(spark, path, version=version, since=since, until=until).where(F.col("project_id") == project_id)
    hours = _whole(hours, F.col("start"), first, end) if first or end or not edges else hours.where(F.lit(False))
    counted = hours if rows is None else hours.unionByName(store.partial_counts(rows), allowMissingColumns=True)
    totals, tags = counted.where("tag = 'total'"), counted.where("tag <> 'total'")
    buckets = totals.groupBy(bucket_start(F.col("start"), width).alias("start")).agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("count"), "key"))
    tops = tags.groupBy("tag", "key").agg(F.sum("count").alias("count")).withColumn("rank", rank).where(F.col("rank") <= (n if 0 < n <= TOP_MOST else TOP)).drop("rank")
    if exact:
        first, end, edges = _split(since, until, 24 * HOUR_NS)
        whole = store.users_by_day(spark, path, version=version, since=since, until=until).where(F.col("project_id") == project_id)
        day = F.unix_seconds(F.col("day").cast("timestamp")) * 1_000_000_000
        whole = (_whole(whole, day, first, end) if first or end or not edges else whole.where(F.lit(False))).select("user_id")
        ends = _edge_rows(spark, path, version, project_id, edges)
        users = unique_users(whole if ends is None else whole.unionByName(ends.select("user_id")), exact=True)
    else:
        users = totals.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("unique_users"))
    return _stats_row(buckets, tops, users)


def unique_users_of_hours(spark: SparkSession, path: str, project_id: int | None, since: int, until: int) -> DataFrame:
    """Estimated users of a stored table in an inclusive range: stored sketches of hours that lie inside it, rows for the rest."""
    if not project_id:
        raise ValueError("a project is required")
    version = versions.latest(spark, path)
    first, end, edges = _split(since, until, HOUR_NS)
    hours = store.rollup(spark, path, version=version, since=since, until=until).where((F.col("project_id") == project_id) & (F.col("tag") == "total"))
    both = (_whole(hours, F.col("start"), first, end) if first or end or not edges else hours.where(F.lit(False))).select("users")
    rows = _edge_rows(spark, path, version, project_id, edges)
    if rows is not None:
        user = F.when(F.col("user_id") != "", F.col("user_id"))
        both = both.unionByName(rows.agg(F.hll_sketch_agg(user, 12).alias("users")))
    return both.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users")), F.lit(0)).alias("unique_users"))


def distinct_fingerprints(events: DataFrame) -> DataFrame:
    return events.select("project_id", "fingerprint").distinct()
