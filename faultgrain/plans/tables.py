"""Error events, keys, rules and commands derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grouping import fingerprint
from ..schema import EXCEPTIONS, SCHEMA_VERSION
from ..sources import store, versions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of fewer partitions than cores (one small file) dealt to all of them; larger ones stay as they are.

    Where a row is much work, ``rows`` are the most that a partition shall hold.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    wanted = max(cores, -(-df.count() // rows)) if rows else cores
    return df.repartition(wanted) if parts < wanted else df


def _level(event_type: Column) -> Column:
    return F.when(event_type == "error", "error").when(event_type == "purchase", "warning").otherwise("info")


def message_input(message: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        empty.alias("platform"), F.array().cast("array<string>").alias("sdk_fingerprint"), message.alias("message"), empty.alias("message_template"),
        F.array().cast(EXCEPTIONS).alias("exceptions"),
    )


def stack_input(event_id: Column, event_type: Column, in_app: Column) -> Column:
    """A grouping input whose frames follow from small remainders of the id."""
    k = lambda n: (event_id % n).cast("string")
    frame = lambda f, m, p, a: F.struct(f.alias("function"), m.alias("module"), p.alias("filename"), F.lit("").alias("abs_path"), a.alias("in_app"))
    none = F.lit(None).cast("boolean")
    frames = F.array(
        frame(F.concat(F.lit("handle$"), k(3)), F.lit("org.apache.web"), F.lit(""), none),
        frame(F.concat(F.lit("load"), k(5)), F.concat(F.lit("shop.cart"), k(7)), F.lit(""), in_app),
        frame(F.lit("run.func1"), F.lit(""), F.concat(F.lit("/srv/build-"), k(11), F.lit("/app/main.js")), none),
    )
    last = F.struct(F.concat(event_type, F.lit("Error")).alias("type"), F.concat(F.lit("code "), k(13)).alias("value"), frames.alias("frames"))
    return F.struct(
        F.lit("java").alias("platform"), F.array().cast("array<string>").alias("sdk_fingerprint"), F.lit("").alias("message"), F.lit("").alias("message_template"), F.array(last).alias("exceptions")
    )


def error_events(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """``events`` as error events, with arrival_seq and basis beside the stored columns; in partitions of at most ``rows``, if given."""
    e = spread(table(spark, sf_dir, "events"), rows)
    id_text = F.col("event_id").cast("string")
    rows = e.select(
        F.col("event_id").alias("arrival_seq"),
        F.md5(id_text.cast("binary")).alias("event_id"),
        (F.col("user_id") % 4 + 1).cast("bigint").alias("project_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        _level(F.col("event_type")).alias("level"),
        F.concat(F.lit("1."), (F.col("event_id") % 4).cast("string"), F.lit(".0")).alias("release"),
        F.when(F.col("event_id") % 3 == 0, "production").when(F.col("event_id") % 3 == 1, "staging").otherwise("").alias("environment"),
        F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user_id"),
        F.concat(F.col("event_type"), F.lit(" failed for user "), F.col("user_id").cast("string"), F.lit(" with "), F.col("props")).alias("message"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("event_type"),
        F.col("event_id").alias("number"),
    )
    g = fingerprint(message_input(F.col("message")))
    return rows.withColumn("g", g).select("*", F.col("g.fingerprint").alias("fingerprint"), F.col("g.basis").alias("basis"), F.lit(SCHEMA_VERSION).alias("schema_version")).drop("g")


#: The same view for DuckDB.
ERROR_EVENTS = """
error_events AS (
  SELECT *, substr(sha1('msg' || chr(0) || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
      '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'), '0x[0-9a-fA-F]+', '<addr>', 'g'),
      '\\b[0-9a-fA-F]{16,}\\b', '<hex>', 'g'), '[0-9]+', '<num>', 'g'))), 1, 32) AS fingerprint, 'message' AS basis
  FROM (
    SELECT event_id AS arrival_seq, md5(event_id::VARCHAR) AS event_id, (user_id % 4 + 1)::BIGINT AS project_id, epoch_us(ts) * 1000 AS ts_ns,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS level,
      '1.' || (event_id % 4) || '.0' AS release,
      CASE event_id % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE '' END AS environment,
      CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || user_id END AS user_id,
      event_type || ' failed for user ' || user_id || ' with ' || props AS message, ts, event_type, event_id AS number
    FROM events))
"""


def projects(spark: SparkSession) -> DataFrame:
    """Five projects of two organisations."""
    return spark.range(1, 6).select(F.col("id"), (F.col("id") % 2 + 1).alias("org_id"), F.concat(F.lit("Shop App_"), F.col("id").cast("string")).alias("name"))


PROJECTS = "projects AS (SELECT i AS id, i % 2 + 1 AS org_id, 'Shop App_' || i AS name FROM range(1, 6) r(i))"


def project_keys(spark: SparkSession) -> DataFrame:
    """Three keys a project, the first one not active; project 5 has no active key."""
    ids = spark.range(3, 18)
    return ids.select(F.col("id"), F.floor(F.col("id") / 3).alias("project_id"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("public_key"), ((F.col("id") % 3 != 0) & (F.col("id") < 15)).alias("is_active"))


KEYS = "project_keys AS (SELECT i AS id, i // 3 AS project_id, 'key' || i AS public_key, i % 3 <> 0 AND i < 15 AS is_active FROM range(3, 18) r(i))"


_written: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table that a session writes once for the given tables, as long as their events don't change."""
    files, at = versions.file_system(spark, sf_dir)
    source = files.getContentSummary(at(f"{sf_dir}/events.parquet")).getLength(), files.getFileStatus(at(f"{sf_dir}/events.parquet")).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, name, source)
    if key not in _written:
        path = store.scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def event_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the stored event table lies."""
    rows = error_events(spark, sf_dir).withColumn("payload", F.lit(None).cast("binary"))
    return _once(spark, sf_dir, "event_table", lambda path: store.write_events(rows, path))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored event table: error events in pruned directories, as queries read them."""
    return store.read_events(spark, event_table_path(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored hit per event; arrival numbers leave room for commands between them."""
    rows = _hits(error_events(spark, sf_dir))
    return spark.read.schema(rows.schema).parquet(_once(spark, sf_dir, "hits", rows.write.parquet))


def _hits(e: DataFrame) -> DataFrame:
    return e.select((F.col("arrival_seq") * 10).alias("arrival_seq"), "project_id", "fingerprint", "basis", F.col("message").alias("title"), "level", F.col("ts_ns").alias("seen_at"))


HITS = "hits AS (SELECT arrival_seq * 10 AS arrival_seq, project_id, fingerprint, basis, message AS title, level, ts_ns AS seen_at FROM error_events)"


def _message_fingerprint(kind: str) -> str:
    import hashlib

    return hashlib.sha1(f"msg\0{kind} failed for user <num> with {{\"k\": <num>}}".encode()).hexdigest()[:32]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: resolve, ignore and reopen issues, merge two, split one, at fixed shares of the table."""
    last = table(spark, sf_dir, "events").agg(F.max("event_id").alias("last"))
    click, error, view = (F.lit(_message_fingerprint(k)) for k in ("click", "error", "view"))
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    steps = [(10, "status", error, null, none, "resolved"), (20, "merge", null, error, F.array(click), null), (30, "status", error, null, none, "resolved"),
             (40, "merge", null, view, F.array(error), null), (55, "status", view, null, none, "ignored"), (60, "split", click, null, none, null),
             (70, "status", click, null, none, "resolved"), (80, "status", view, null, none, "closed"), (85, "merge", null, error, F.array(view), null)]
    one = F.array(*(F.struct((F.floor(F.col("last") * share / 100) * 10 + 5).cast("bigint").alias("arrival_seq"), F.lit(kind).alias("kind"), f.alias("fingerprint"), t.alias("target"), s.alias("sources"), (F.lit(st) if isinstance(st, str) else st).alias("status")) for share, kind, f, t, s, st in steps))
    each = last.select(F.explode(one).alias("c")).select("c.*")
    return spark.range(1, 5).select(F.col("id").alias("project_id")).join(each).select("arrival_seq", "project_id", "kind", "fingerprint", "target", "sources", "status")
