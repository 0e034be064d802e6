"""The registered queries and their SQL for the reference tables.

Each runs over whole tables. Projects, keys, rules and commands follow from
arithmetic in both engines (see ``tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grouping as g
from ..functions import text as t
from ..functions.rules import with_enhanced_frames, with_first_rule
from ..operators import access, alerts, issues, ops, query, quota
from ..sources import ingest, store
from . import tables
from .tables import ERROR_EVENTS, HITS, KEYS, PROJECTS, error_events, event_table, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = t.HOUR_NS


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- scans and statistics -------------------------------------------------


@_register(f"""WITH {ERROR_EVENTS}, b AS (SELECT min(ts_ns) + 86400000000000 AS lo, max(ts_ns) - 86400000000000 AS hi FROM error_events)
SELECT ts_ns - ts_ns % {HOUR} AS start, count(*) AS count FROM error_events, b WHERE project_id = 1 AND ts_ns BETWEEN lo AND hi GROUP BY 1""")
def hourly_counts(spark, sf_dir):
    """Hourly counts of one project in an inclusive time range."""
    events = event_table(spark, sf_dir)
    low, high = events.agg(F.min("ts_ns"), F.max("ts_ns")).collect()[0]
    day = 24 * HOUR
    found = query.matching(query.lite(events), 1, since=low + day, until=high - day)
    return query.ordered_buckets(query.bucket_counts(found))


@_register(f"WITH {ERROR_EVENTS} SELECT project_id, ts_ns - ts_ns % {HOUR} AS start, count(*) AS count FROM error_events GROUP BY ALL")
def bucket_counts(spark, sf_dir):
    return query.bucket_counts(event_table(spark, sf_dir), by=("project_id",))


@_register(f"""WITH {ERROR_EVENTS}, p AS (
  SELECT project_id, unnest([{{'tag': 'level', 'key': level}}, {{'tag': 'release', 'key': release}}, {{'tag': 'environment', 'key': environment}}, {{'tag': 'fingerprint', 'key': fingerprint}}]) AS x FROM error_events),
c AS (SELECT project_id, x.tag AS tag, x.key AS key, count(*) AS count FROM p WHERE x.key <> '' GROUP BY ALL)
SELECT project_id, tag, key, count FROM c QUALIFY row_number() OVER (PARTITION BY project_id, tag ORDER BY count DESC, key) <= 3""")
def top_values(spark, sf_dir):
    return query.top_values(event_table(spark, sf_dir), 3, by=("project_id",))


@_register(f"WITH {ERROR_EVENTS} SELECT count(DISTINCT user_id) AS unique_users FROM error_events WHERE project_id = 2 AND user_id <> ''")
def unique_users_exact(spark, sf_dir):
    return query.unique_users(query.scope(event_table(spark, sf_dir), 2), exact=True)


@_register()
def unique_users_sketch(spark, sf_dir):
    return query.unique_users(query.scope(event_table(spark, sf_dir), 2))


@_register(f"WITH {ERROR_EVENTS} SELECT count(*) AS total FROM error_events WHERE project_id = 3 AND level = 'error' AND environment = 'staging'")
def total_matching(spark, sf_dir):
    return query.total(query.matching(event_table(spark, sf_dir), 3, level="error", environment="staging"))


@_register(f"""WITH {ERROR_EVENTS}, e AS (SELECT * FROM error_events WHERE project_id = 1),
p AS (SELECT unnest([{{'tag': 'level', 'key': level}}, {{'tag': 'release', 'key': release}}, {{'tag': 'environment', 'key': environment}}, {{'tag': 'fingerprint', 'key': fingerprint}}]) AS x FROM e),
c AS (SELECT x.tag AS tag, x.key AS key, count(*) AS count FROM p WHERE x.key <> '' GROUP BY ALL)
SELECT tag, key, count FROM c QUALIFY row_number() OVER (PARTITION BY tag ORDER BY count DESC, key) <= 10
UNION ALL SELECT 'bucket', (ts_ns - ts_ns % {HOUR})::VARCHAR, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM e
UNION ALL SELECT 'users', '', count(DISTINCT user_id) FILTER (user_id <> '') FROM e""")
def window_stats(spark, sf_dir):
    """Total, buckets, top values and exact users of a project, a row for each number."""
    return _stats_rows(query.stored_window_stats(spark, tables.event_table_path(spark, sf_dir), 1, exact=True))


@_register(f"""WITH {ERROR_EVENTS}, b AS (SELECT min(ts_ns) + {5 * HOUR // 2} AS lo, max(ts_ns) - {61 * HOUR // 2} AS hi FROM error_events),
e AS (SELECT error_events.* FROM error_events, b WHERE project_id = 3 AND ts_ns BETWEEN lo AND hi),
p AS (SELECT unnest([{{'tag': 'level', 'key': level}}, {{'tag': 'release', 'key': release}}, {{'tag': 'environment', 'key': environment}}, {{'tag': 'fingerprint', 'key': fingerprint}}]) AS x FROM e),
c AS (SELECT x.tag AS tag, x.key AS key, count(*) AS count FROM p WHERE x.key <> '' GROUP BY ALL)
SELECT tag, key, count FROM c QUALIFY row_number() OVER (PARTITION BY tag ORDER BY count DESC, key) <= 10
UNION ALL SELECT 'bucket', (ts_ns - ts_ns % {24 * HOUR})::VARCHAR, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM e
UNION ALL SELECT 'users', '', count(DISTINCT user_id) FILTER (user_id <> '') FROM e""")
def window_stats_range(spark, sf_dir):
    """The same of a range that begins and ends inside an hour, in buckets of a day: stored aggregates and rows of the ends."""
    path = tables.event_table_path(spark, sf_dir)
    low, high = store.stored_manifest(spark, path).agg(F.min("min_ts"), F.max("max_ts")).collect()[0]
    return _stats_rows(query.stored_window_stats(spark, path, 3, since=low + 5 * HOUR // 2, until=high - 61 * HOUR // 2, width=24 * HOUR, exact=True))


def _stats_rows(stats):
    """A row for each number of window statistics."""
    one = lambda tag, key, count: F.struct(F.lit(tag).alias("tag"), key.alias("key"), count.alias("count"))
    empty = F.lit("")
    parts = [F.array(one("total", empty, F.col("total")), one("users", empty, F.col("unique_users"))), F.transform("buckets", lambda b: one("bucket", b["start"].cast("string"), b["count"]))]
    none = F.filter(parts[0], lambda x: F.lit(False))
    of = lambda tag: F.transform(F.try_element_at("top_by", F.lit(tag)), lambda x: one(tag, x["key"], x["count"]))
    parts += [F.coalesce(of(tag), none) for tag in query.TAGS]
    return stats.select(F.inline(F.concat(*parts)))


@_register(f"WITH {ERROR_EVENTS} SELECT DISTINCT project_id, fingerprint FROM error_events WHERE release = '1.2.0'")
def distinct_fingerprints(spark, sf_dir):
    return query.distinct_fingerprints(event_table(spark, sf_dir).where(query.event_predicate(release="1.2.0")))


@_register(f"WITH {ERROR_EVENTS} SELECT event_id, ts_ns, level, user_id FROM error_events WHERE project_id = 4 AND level = 'warning' ORDER BY ts_ns DESC, event_id LIMIT 42")
def scan_limit(spark, sf_dir):
    return query.scan(event_table(spark, sf_dir), 4, 42, level="warning").select("event_id", "ts_ns", "level", "user_id")


@_register(f"WITH {ERROR_EVENTS} SELECT event_id, props->>'k' AS k, true AS is_json FROM error_events JOIN (SELECT event_id AS number, props FROM events) USING (number)")
def raw_page(spark, sf_dir):
    """Payloads as JSON."""
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.col("props").cast("binary").alias("payload"))
    page = query.raw_page(error_events(spark, sf_dir).join(raw, "number"))
    return page.select("event_id", F.variant_get("payload", "$.k", "string").alias("k"), F.col("payload").isNotNull().alias("is_json"))


# ---- fingerprints and text ------------------------------------------------

_CUT = "left({0}, list_max(list_filter(range(0, {1} + 1), lambda k: strlen(left({0}, k)) <= {1})))"
_NORMAL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},
  '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '<uuid>', 'g'), '0x[0-9a-fA-F]+', '<addr>', 'g'),
  '\\b[0-9a-fA-F]{{16,}}\\b', '<hex>', 'g'), '[0-9]+', '<num>', 'g'), '^\\s+|\\s+$', '', 'g')"""


@_register(f"""WITH n AS (SELECT doc_id, text, {_NORMAL.format(_CUT.format('text', 512))} AS normal FROM documents)
SELECT doc_id, normal, CASE WHEN text = '' THEN substr(sha1('fallback'), 1, 32) ELSE substr(sha1('msg' || chr(0) || normal), 1, 32) END AS fingerprint,
  CASE WHEN text = '' THEN 'fallback' ELSE 'message' END AS basis FROM n""")
def message_fingerprints(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", t.normalize_message(F.col("text")).alias("normal"), g.fingerprint(tables.message_input(F.col("text"))).alias("g"))
    return found.select("doc_id", "normal", "g.fingerprint", "g.basis")


_FRAME2 = "'shop.cart' || (event_id % 7) || chr(0) || 'load' || (event_id % 5) || chr(0) || "
_FRAME3 = "'build-<num>/app/main.js' || chr(0) || 'run.<gen>'"


def _stack(spark, sf_dir):
    e = spread(table(spark, sf_dir, "events"))
    hint = F.when(F.col("event_id") % 4 == 1, False).when(F.col("event_id") % 4 == 2, True)
    return e.select("event_id", "user_id", "event_type", tables.stack_input(F.col("event_id"), F.col("event_type"), hint).alias("input"))


@_register(f"""SELECT event_id, 'stacktrace' AS basis, substr(sha1('stack' || chr(0) || event_type || 'Error' || chr(0) ||
  CASE WHEN event_id % 4 = 1 THEN '' ELSE {_FRAME2} '' END || {_FRAME3}), 1, 32) AS fingerprint FROM events""")
def stack_fingerprints(spark, sf_dir):
    return _stack(spark, sf_dir).select("event_id", g.fingerprint(F.col("input")).alias("g")).select("event_id", "g.basis", "g.fingerprint")


@_register("""SELECT event_id, 'exception' AS basis, substr(sha1('exc' || chr(0) || event_type || 'Error' || chr(0) || 'code <num>'), 1, 32) AS fingerprint FROM events""")
def exception_fingerprints(spark, sf_dir):
    rows = _stack(spark, sf_dir)
    bare = F.transform("input.exceptions", lambda e: e.withField("frames", F.slice(e["frames"], 1, 0)))
    rows = rows.withColumn("input", F.col("input").withField("exceptions", bare))
    return rows.select("event_id", g.fingerprint(F.col("input")).alias("g")).select("event_id", "g.basis", "g.fingerprint")


@_register(f"""WITH d AS (SELECT event_id, event_type, substr(sha1('stack' || chr(0) || event_type || 'Error' || chr(0) ||
  CASE WHEN event_id % 4 = 1 THEN '' ELSE {_FRAME2} '' END || {_FRAME3}), 1, 32) AS f FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'stacktrace' ELSE 'custom' END AS basis,
  CASE event_id % 3 WHEN 0 THEN f WHEN 1 THEN substr(sha1('custom' || chr(0) || f || chr(0) || event_type), 1, 32)
  ELSE substr(sha1('custom' || chr(0) || 'mine'), 1, 32) END AS fingerprint FROM d""")
def custom_fingerprints(spark, sf_dir):
    k = F.col("event_id") % 3
    own = F.when(k == 0, F.array(F.lit(" {{default}} "))).when(k == 1, F.array(F.lit("{{ default }}"), F.col("event_type"))).otherwise(F.array(F.lit("mine")))
    rows = _stack(spark, sf_dir).withColumn("input", F.col("input").withField("sdk_fingerprint", own))
    return rows.select("event_id", g.fingerprint(F.col("input")).alias("g")).select("event_id", "g.basis", "g.fingerprint")


@_register(f"""SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 13 IN (1, 10, 11, 12) OR event_id % 7 = 3 THEN 'rule' ELSE 'stacktrace' END AS basis,
  substr(sha1(CASE WHEN event_type = 'error' AND event_id % 13 IN (1, 10, 11, 12) THEN 'rule' || chr(0) || 'err-one'
    WHEN event_id % 7 = 3 THEN 'rule' || chr(0) || 'cart' || chr(0) || 'three'
    ELSE 'stack' || chr(0) || event_type || 'Error' || chr(0) || CASE WHEN event_id % 4 = 1 THEN '' ELSE {_FRAME2} '' END || {_FRAME3} END), 1, 32) AS fingerprint
FROM events""")
def rule_fingerprints(spark, sf_dir):
    """Fingerprint rules: the first whose matchers all hold."""
    spec = [
        (1, [("type", "error*"), ("value", "code 1*")], ["err-one"]),
        (2, [("platform", "[!x]"), ("type", "*")], ["never"]),
        (3, [("module", "shop.cart[3]"), ("path", "**/app/*.js")], ["cart", "three"]),
        (4, [], ["empty"]),
    ]
    one = [(p, n, [{"type": k, "pattern": v} for k, v in m], f) for p in range(1, 5) for n, m, f in spec]
    rules = spark.createDataFrame(one, "project_id bigint, rule_order int, matchers array<struct<type: string, pattern: string>>, fingerprint array<string>")
    rows = with_first_rule(_stack(spark, sf_dir).withColumn("project_id", F.col("user_id") % 4 + 1), rules)
    return rows.select("event_id", g.fingerprint(F.col("input"), ruled=F.col("ruled")).alias("g")).select("event_id", "g.basis", "g.fingerprint")


@_register(f"""SELECT event_id,
  substr(sha1('stack' || chr(0) || event_type || 'Error' || chr(0) ||
  CASE WHEN event_id % 4 = 1 AND event_id % 7 <> 5 THEN 'org.apache.web' || chr(0) || 'handle' || chr(0) || {_FRAME2} {_FRAME3}
    ELSE 'shop.cart' || (event_id % 7) || chr(0) || 'load' || (event_id % 5) END), 1, 32) AS fingerprint FROM events""")
def enhanced_fingerprints(spark, sf_dir):
    """Enhancement rules force in_app by path or module, first match wins."""
    rows = [(p, n, pattern, by_module, value) for p in range(1, 5) for n, pattern, by_module, value in ((1, "**/app/**", False, False), (2, "shop.cart5", True, True), (3, "shop.**", True, None))]
    rules = spark.createDataFrame(rows, "project_id bigint, rule_order int, pattern string, match_module boolean, in_app boolean")
    rows = with_enhanced_frames(_stack(spark, sf_dir).withColumn("project_id", F.col("user_id") % 4 + 1), rules)
    return rows.select("event_id", g.fingerprint(F.col("input"))["fingerprint"].alias("fingerprint"))


@_register(f"""SELECT doc_id, {_CUT.format('text', 200)} AS title,
  CASE WHEN s = '' THEN 'default' ELSE s END AS slug,
  replace(replace(replace(text, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped,
  'https://key' || doc_id || '@errors.example.com:8443/' || doc_id AS dsn, 'http://k@localhost:8080/' || doc_id AS local_dsn
FROM (SELECT *, translate(lower(regexp_replace(text, '[^A-Za-z0-9 _-]', '', 'g')), ' _', '--') AS s FROM documents)""")
def text_functions(spark, sf_dir):
    docs, key = table(spark, sf_dir, "documents"), F.concat(F.lit("key"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", t.truncate_bytes(F.col("text"), 200).alias("title"), t.slugify(F.col("text")).alias("slug"), t.escape_like(F.col("text")).alias("escaped"),
        t.dsn(F.lit("https://errors.example.com:8443/x"), key, F.col("doc_id")).alias("dsn"), t.dsn(F.lit("nowhere"), F.lit("k"), F.col("doc_id")).alias("local_dsn"),
    )


# ---- ingest ---------------------------------------------------------------


RECORDS = 100_000  # in a task that decodes them


def _records(spark, sf_dir):
    """Envelopes and single JSON records of all events; every tenth comes twice, some are broken or wrongly keyed."""
    e = error_events(spark, sf_dir, RECORDS)
    user = F.struct(F.when(F.col("user_id") != "", F.col("user_id")).alias("id"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = F.struct(F.upper("event_id").alias("event_id"), iso.alias("timestamp"), "level", "release", "environment", "message", user.alias("user"))
    event = F.to_json(fields)
    envelope = F.concat(F.lit('{"sent_at":null}\n{"type":"event","length":'), F.octet_length(event).cast("string"), F.lit("}\n"), event, F.lit('\n{"type":"session"}\n{}\n{"type":"new_kind"}\nx\n'))
    n = F.col("number")
    body = F.when(n % 97 == 0, F.lit('{"broken')).when(n % 5 == 0, event).otherwise(envelope)
    rows = e.select(
        F.col("arrival_seq"), F.col("ts").alias("received_at"), F.when(n % 5 == 0, 2).otherwise(1).cast("tinyint").alias("kind"), "project_id",
        F.when(n % 89 == 0, "wrong").otherwise(F.concat(F.lit("key"), (F.col("project_id") * 3 + 1).cast("string"))).alias("public_key"), F.lit("").alias("content_encoding"), body.cast("binary").alias("body"),
    )
    again = rows.where("arrival_seq % 10 = 0").withColumn("arrival_seq", F.col("arrival_seq") + 1_000_000_000)
    return rows.unionByName(again)


def _ingested(spark, sf_dir):
    return ingest.ingest(_records(spark, sf_dir), tables.project_keys(spark))


@_register(f"""WITH {ERROR_EVENTS} SELECT arrival_seq, project_id, event_id, ts_ns, level, release, environment, user_id, message, fingerprint, basis
FROM error_events WHERE number % 89 <> 0 AND number % 97 <> 0""")
def ingest_stored(spark, sf_dir):
    """Decode, authenticate, normalise, fingerprint, drop duplicates: what is stored."""
    rows = ingest.stored(_ingested(spark, sf_dir))
    return rows.select("arrival_seq", "project_id", "event_id", "ts_ns", "level", "release", "environment", "user_id", "message", "fingerprint", "basis")


_REJECTS = """r AS (SELECT arrival_seq + c AS arrival_seq, project_id, CASE WHEN number % 89 = 0 THEN 'auth' WHEN number % 97 = 0 THEN 'malformed' WHEN c > 0 THEN 'duplicate' END AS reason
  FROM error_events, (VALUES (0), (1000000000)) v(c) WHERE c = 0 OR number % 10 = 0)"""


@_register(f"WITH {ERROR_EVENTS}, {_REJECTS} SELECT arrival_seq, project_id, reason FROM r WHERE reason IS NOT NULL")
def ingest_rejected(spark, sf_dir):
    return ingest.rejected(_ingested(spark, sf_dir)).select("arrival_seq", "project_id", "reason")


@_register(f"WITH {ERROR_EVENTS}, {_REJECTS} SELECT reason, count(*) AS count FROM r WHERE reason IS NOT NULL GROUP BY reason")
def drops_by_reason(spark, sf_dir):
    return ops.drops_by_reason(_ingested(spark, sf_dir))


@_register(f"""WITH {ERROR_EVENTS}, {_REJECTS} SELECT count(*) AS received, count(*) FILTER (reason IS NULL AND arrival_seq < 1000000000) AS stored, count(reason) FILTER (arrival_seq < 1000000000) AS dropped,
  count(*) FILTER (arrival_seq >= 1000000000) AS lag, (SELECT count(DISTINCT (project_id, ts_ns - ts_ns % {HOUR})) FROM error_events WHERE number % 89 <> 0 AND number % 97 <> 0) AS segments FROM r""")
def ingest_status(spark, sf_dir):
    """Status while the second copies still wait."""
    records = _records(spark, sf_dir)
    return ops.ingest_status(records, ingest.ingest(records.where("arrival_seq < 1000000000"), tables.project_keys(spark)))


@_register(f"WITH {ERROR_EVENTS}, {_REJECTS} SELECT count(*) AS items_in, count(*) FILTER (reason IS NULL) AS stored, count(reason) AS rejected, 0::BIGINT AS missing FROM r")
def accounting(spark, sf_dir):
    done = _ingested(spark, sf_dir)
    return ops.accounting(_records(spark, sf_dir), ingest.stored(done), ingest.rejected(done))


@_register(f"""WITH {ERROR_EVENTS}, {HITS} SELECT arrival_seq // 10 AS arrival_seq, project_id, fingerprint, basis, {_CUT.format('title', 200)} AS title, level, seen_at
FROM hits WHERE (arrival_seq // 10) % 89 <> 0 AND (arrival_seq // 10) % 97 <> 0""")
def issue_hits(spark, sf_dir):
    return ingest.issue_hits(ingest.stored(_ingested(spark, sf_dir)))


def _compressed(batches):
    import gzip
    import zlib

    pack = {"": bytes, "gzip": gzip.compress, "deflate": zlib.compress}
    for batch in batches:
        yield batch.assign(body=[pack[kind](body) for kind, body in zip(batch["content_encoding"], batch["body"], strict=True)])


@_register(f"""SELECT event_id AS arrival_seq, event_type || 'Error: code ' || (event_id % 13) AS message, 'stacktrace' AS basis,
  substr(sha1('stack' || chr(0) || event_type || 'Error' || chr(0) || {_FRAME2} {_FRAME3}), 1, 32) AS fingerprint FROM events""")
def ingest_exceptions(spark, sf_dir):
    """Compressed records whose exceptions come as an object or as a bare array."""
    e = spread(table(spark, sf_dir, "events"), RECORDS)
    n = F.col("event_id")
    trace = lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), F.struct(x["frames"].alias("frames")).alias("stacktrace"))
    own = F.transform(tables.stack_input(n, F.col("event_type"), F.lit(None).cast("boolean"))["exceptions"], trace)
    event_id = F.md5(n.cast("string").cast("binary")).alias("event_id")
    body = F.when(n % 2 == 0, F.to_json(F.struct(event_id, F.struct(own.alias("values")).alias("exception")))).otherwise(F.to_json(F.struct(event_id, own.alias("exception"))))
    rows = e.select(
        n.alias("arrival_seq"), F.col("ts").cast("timestamp").alias("received_at"), F.lit(2).cast("tinyint").alias("kind"), (F.col("user_id") % 4 + 1).cast("bigint").alias("project_id"),
        F.concat(F.lit("key"), ((F.col("user_id") % 4 + 1) * 3 + 1).cast("string")).alias("public_key"),
        F.when(n % 3 == 1, "gzip").when(n % 3 == 2, "deflate").otherwise("").alias("content_encoding"), body.cast("binary").alias("body"),
    )
    rows = ingest.stored(ingest.ingest(rows.mapInPandas(_compressed, rows.schema), tables.project_keys(spark)))
    return rows.select("arrival_seq", "message", "basis", "fingerprint")


@_register(f"WITH {ERROR_EVENTS}, {PROJECTS} SELECT arrival_seq, project_id, org_id FROM error_events LEFT JOIN projects ON projects.id = project_id")
def events_with_org(spark, sf_dir):
    return ingest.with_org(error_events(spark, sf_dir), tables.projects(spark)).select("arrival_seq", "project_id", "org_id")


# ---- the event table ------------------------------------------------------


def _written(spark, sf_dir):
    events = error_events(spark, sf_dir).withColumn("payload", F.col("message").cast("binary"))
    path = store.scratch_path(spark, "events")
    store.write_events(events.where("number % 2 = 0"), path)
    store.write_events(events.where("number % 2 = 1"), path)
    return path


@_register(f"WITH {ERROR_EVENTS} SELECT project_id, count(*) AS rows, count(DISTINCT event_id) AS ids, min(ts_ns) AS first, max(ts_ns) AS last FROM error_events GROUP BY project_id")
def event_table_write(spark, sf_dir):
    """Fingerprint all events and write the event table that the statistics read; its rows by project."""
    rows = event_table(spark, sf_dir).groupBy("project_id")
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"), F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"))


_SCAN = f"""WITH {ERROR_EVENTS}, b AS (SELECT min(ts_ns) AS lo FROM error_events)
SELECT project_id, event_id, ts_ns, level, fingerprint, user_id, message FROM error_events, b WHERE project_id = 2 AND level = 'error' AND ts_ns BETWEEN lo + {6 * HOUR} AND lo + {72 * HOUR}"""


def _scan_written(spark, sf_dir):
    events = event_table(spark, sf_dir)
    low = events.agg(F.min("ts_ns")).collect()[0][0]
    found = query.matching(events, 2, level="error", since=low + 6 * HOUR, until=low + 72 * HOUR)
    return found.select("project_id", "event_id", "ts_ns", "level", "fingerprint", "user_id", "message")


@_register(_SCAN)
def store_scan(spark, sf_dir):
    """Written by date and project bucket, read back with directory pruning."""
    return _scan_written(spark, sf_dir)


@_register(f"""WITH {ERROR_EVENTS} SELECT project_id, strftime(make_timestamp(ts_ns // 1000), '%Y%m%d%H')::INT AS hour, count(*) AS rows, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts
FROM error_events GROUP BY ALL""")
def store_manifest(spark, sf_dir):
    """Manifest as its commits wrote it, after compaction folded two of them."""
    path = _written(spark, sf_dir)
    store.compact(spark, path)
    return store.stored_manifest(spark, path).drop("users")


@_register(f"WITH {ERROR_EVENTS} SELECT project_id, level, count(*) AS rows, count(DISTINCT event_id) AS ids FROM error_events GROUP BY ALL")
def store_replays(spark, sf_dir):
    """Batches of a writer, each run twice, once after compaction: every event is there once."""
    events = error_events(spark, sf_dir).withColumn("payload", F.lit(None).cast("binary"))
    path = store.scratch_path(spark, "replays")
    for batch in (0, 1, 0, 1, 2):
        store.write_events(events.where(F.col("number") % 3 == batch), path, writer="ingest", batch=batch)
    store.compact(spark, path)
    for batch in (1, 2):
        store.write_events(events.where(F.col("number") % 3 == batch), path, writer="ingest", batch=batch)
    return store.read_events(spark, path).groupBy("project_id", "level").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"))


@_register(f"""WITH {ERROR_EVENTS}, b AS (SELECT min(ts_ns) // {24 * HOUR} + 2 AS day FROM error_events)
SELECT project_id, count(*) AS rows, min(ts_ns) AS first FROM error_events, b WHERE ts_ns // {24 * HOUR} >= day GROUP BY project_id""")
def retention_drop(spark, sf_dir):
    """What is left when the first two days of a stored table are dropped."""
    path = _written(spark, sf_dir)
    low = store.stored_manifest(spark, path).agg(F.min("min_ts")).collect()[0][0]
    store.drop_before(spark, path, store.day_of(low + 48 * HOUR))
    store.vacuum(spark, path, 0)
    return store.read_events(spark, path).groupBy("project_id").agg(F.count("*").alias("rows"), F.min("ts_ns").alias("first"))


@_register(f"""WITH {ERROR_EVENTS}, s AS (SELECT strftime(make_timestamp(ts_ns // 1000), '%Y%m%d%H')::INT AS segment, sum(strlen(message)) AS bytes, max(ts_ns) AS newest_ns, max(arrival_seq) AS end_offset FROM error_events GROUP BY ALL),
m AS (SELECT max(newest_ns) AS now_ns, sum(bytes) // 2 AS cap, max(end_offset) * 2 // 5 AS floor FROM s),
c AS (SELECT s.*, end_offset <= floor AND segment <> max(segment) OVER () AND (sum(bytes) OVER (ORDER BY segment DESC) > cap OR now_ns - newest_ns > {48 * HOUR}) AS goes FROM s, m)
SELECT segment, bytes::BIGINT AS bytes, newest_ns, end_offset FROM c QUALIFY bool_and(goes) OVER (ORDER BY segment)""")
def retention(spark, sf_dir):
    """Oldest hours to drop by size, age and consumed offset."""
    e = error_events(spark, sf_dir)
    segments = e.groupBy(t.hour_key(F.col("ts_ns")).alias("segment")).agg(F.sum(F.octet_length("message")).alias("bytes"), F.max("ts_ns").alias("newest_ns"), F.max("arrival_seq").alias("end_offset"))
    row = segments.agg(F.max("newest_ns").alias("now"), F.sum("bytes").alias("bytes"), F.max("end_offset").alias("end")).collect()[0]
    return store.expired(segments, now_ns=row["now"], max_bytes=row["bytes"] // 2, max_age_ns=48 * HOUR, min_offset=row["end"] * 2 // 5)


@_register(f"WITH {ERROR_EVENTS} SELECT event_id, project_id, level FROM error_events")
def union_tiers(spark, sf_dir):
    """Unwritten and stored rows with an overlap."""
    e = error_events(spark, sf_dir).withColumn("payload", F.lit(None).cast("binary"))
    return store.union_tiers(e.where("number % 3 > 0"), e.where("number % 3 < 2")).select("event_id", "project_id", "level")


@_register()
def users_of_covered_hours(spark, sf_dir):
    """Users from stored sketches of whole hours and rows of the edges."""
    path = tables.event_table_path(spark, sf_dir)
    low, high = store.stored_manifest(spark, path).agg(F.min("min_ts"), F.max("max_ts")).collect()[0]
    return query.unique_users_of_hours(spark, path, 2, low + HOUR // 2, high - HOUR // 2)


# ---- issues ---------------------------------------------------------------


@_register(f"""WITH {ERROR_EVENTS}, {HITS} SELECT project_id, fingerprint, arg_min(basis, arrival_seq) AS basis, arg_min(title, arrival_seq) AS title, arg_max(level, arrival_seq) AS level,
  arg_min(seen_at, arrival_seq) AS first_seen, max(seen_at) AS last_seen, count(*) AS times_seen FROM hits GROUP BY ALL""")
def issue_rollup(spark, sf_dir):
    return issues.rollup(tables.hits(spark, sf_dir))


def _fp(kind: str) -> str:
    return f"substr(sha1('msg' || chr(0) || '{kind} failed for user <num> with {{\"k\": <num>}}'), 1, 32)"


_TIMELINE = f"""
k AS (SELECT {_fp('click')} AS c, {_fp('error')} AS e, {_fp('view')} AS v, max(event_id) AS n FROM events),
s AS (SELECT c, e, v, {', '.join(f'n * {x} // 100 * 10 + 5 AS s{x}' for x in (10, 20, 30, 40, 55, 60, 70))} FROM k),
routed AS (SELECT h.*, CASE WHEN fingerprint = c AND arrival_seq > s20 AND arrival_seq < s40 THEN e WHEN fingerprint = c AND arrival_seq > s40 AND arrival_seq < s60 THEN v
    WHEN fingerprint = e AND arrival_seq > s40 THEN v ELSE fingerprint END AS target,
  row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY arrival_seq) = 1 AS is_new FROM hits h, s),
n20 AS (SELECT project_id, count(*) AS n FROM routed, s WHERE target = c AND arrival_seq < s20 GROUP BY project_id),
n40 AS (SELECT project_id, count(*) AS n FROM routed, s WHERE target = e AND arrival_seq < s40 GROUP BY project_id),
changes AS (
  SELECT project_id, s20 AS arrival_seq, e AS target, n AS weight, NULL AS st FROM n20, s UNION ALL
  SELECT n40.project_id, s40, v, n40.n + n20.n, NULL FROM n40 JOIN n20 USING (project_id), s UNION ALL
  SELECT p, a, t, 0, st FROM range(1, 5) r(p), (SELECT s10 AS a, e AS t, 'resolved' AS st FROM s UNION ALL SELECT s30, e, 'resolved' FROM s UNION ALL
    SELECT s55, v, 'ignored' FROM s UNION ALL SELECT s60, c, 'unresolved' FROM s UNION ALL SELECT s70, c, 'resolved' FROM s)),
both_ AS (
  SELECT project_id, arrival_seq, fingerprint, level, seen_at, title, basis, target, is_new, 1 AS weight, 'hit' AS prior, NULL AS st, true AS hit FROM routed UNION ALL
  SELECT project_id, arrival_seq, NULL, NULL, NULL, NULL, NULL, target, NULL, weight, st, st, false FROM changes),
ran AS (SELECT *, sum(weight) OVER w AS times_seen,
    last_value(prior IGNORE NULLS) OVER (PARTITION BY project_id, target ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
    coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY project_id, target ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unresolved') AS now_
  FROM both_ WINDOW w AS (PARTITION BY project_id, target ORDER BY arrival_seq)),
timeline AS (SELECT project_id, arrival_seq, fingerprint, level, seen_at, title, basis, target, is_new, NOT is_new AND coalesce(was = 'resolved', false) AS regressed, times_seen::BIGINT AS times_seen,
  CASE WHEN is_new THEN 'unresolved' WHEN now_ = 'resolved' THEN 'regressed' ELSE now_ END AS status FROM ran WHERE hit),
issues AS (
  SELECT h.project_id, h.fingerprint, h.basis, h.title, l.level, l.status_ AS status, h.first_seen, l.last_seen, l.times_seen, h.merged_into
  FROM (SELECT project_id, fingerprint, arg_min(basis, arrival_seq) AS basis, arg_min(title, arrival_seq) AS title, arg_min(seen_at, arrival_seq) AS first_seen,
      CASE WHEN any_value(fingerprint) = any_value(e) THEN any_value(v) END AS merged_into FROM hits, s GROUP BY project_id, fingerprint) h
  JOIN (SELECT project_id, target, arg_max(level, arrival_seq) FILTER (hit) AS level, max(seen_at) AS last_seen, sum(weight)::BIGINT AS times_seen,
      CASE WHEN arg_max(st, arrival_seq) FILTER (st IS NOT NULL) = 'resolved' AND max(arrival_seq) FILTER (hit) > max(arrival_seq) FILTER (st IS NOT NULL) THEN 'regressed'
        ELSE coalesce(arg_max(st, arrival_seq) FILTER (st IS NOT NULL), 'unresolved') END AS status_
    FROM both_ GROUP BY project_id, target) l ON l.project_id = h.project_id AND l.target = h.fingerprint)"""
_BASE = f"WITH {ERROR_EVENTS}, {HITS}, {_TIMELINE}"


def _timeline(spark, sf_dir):
    return issues.timeline(tables.hits(spark, sf_dir), tables.commands(spark, sf_dir))


def _issues(spark, sf_dir):
    return issues.current_issues(tables.hits(spark, sf_dir), tables.commands(spark, sf_dir))


@_register(f"{_BASE} SELECT project_id, arrival_seq, fingerprint, target, is_new, regressed, times_seen, status FROM timeline")
def issue_timeline(spark, sf_dir):
    """Outcome of every hit under status, merge and split commands."""
    return _timeline(spark, sf_dir).select("project_id", "arrival_seq", "fingerprint", "target", "is_new", "regressed", "times_seen", "status")


@_register(f"{_BASE} SELECT * FROM issues")
def current_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@_register(f"{_BASE} SELECT project_id, fingerprint, status, times_seen FROM issues WHERE project_id = 1 AND merged_into IS NULL ORDER BY last_seen DESC, fingerprint LIMIT 3")
def latest_issues(spark, sf_dir):
    return issues.latest_issues(issues.filter_issues(_issues(spark, sf_dir), 1), 3).select("project_id", "fingerprint", "status", "times_seen")


@_register(f"{_BASE} SELECT project_id, fingerprint, status, level FROM issues WHERE project_id = 2 AND merged_into IS NULL AND title ILIKE '%FAILED for user%' AND status <> 'ignored' AND status = 'unresolved'")
def filter_issues(spark, sf_dir):
    found = issues.filter_issues(_issues(spark, sf_dir), 2, status="unresolved", title="FAILED for user")
    return found.select("project_id", "fingerprint", "status", "level")


@_register(f"""{_BASE} SELECT project_id, fingerprint, title FROM issues WHERE project_id = 3 AND merged_into IS NULL AND title ILIKE '%click%'
  AND fingerprint IN (SELECT fingerprint FROM error_events WHERE project_id = 3 AND release = '1.1.0' AND environment = 'staging')""")
def search_issues(spark, sf_dir):
    """Search string with keys of issues and of their events."""
    words = issues.parse_search('release:"1.1.0" env:staging CLICK')
    return issues.search_issues(_issues(spark, sf_dir), error_events(spark, sf_dir), 3, **words).select("project_id", "fingerprint", "title")


@_register(f"""WITH {ERROR_EVENTS}, r AS (SELECT project_id, fingerprint, event_id, ts_ns, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts_ns DESC, event_id)::INT AS rank FROM error_events)
SELECT * FROM r WHERE rank <= 5""")
def latest_events(spark, sf_dir):
    e = event_table(spark, sf_dir)
    return issues.latest_events(query.distinct_fingerprints(e), e).select("project_id", "fingerprint", "event_id", "ts_ns", "rank")


@_register(f"""WITH {ERROR_EVENTS}, f AS (SELECT project_id, fingerprint, min(arrival_seq) AS a FROM error_events GROUP BY ALL), i AS (SELECT project_id, fingerprint, row_number() OVER (ORDER BY a, project_id, fingerprint) AS issue_id FROM f)
SELECT project_id, fingerprint, issue_id FROM i WHERE issue_id = 2 AND project_id = (SELECT project_id FROM i WHERE issue_id = 2)""")
def issue_by_id(spark, sf_dir):
    ids = issues.issue_ids(tables.hits(spark, sf_dir))
    owner = ids.where("issue_id = 2").collect()
    return issues.get_issue(ids, owner[0]["project_id"] if owner else 1, 2)


# ---- alerts and quotas ----------------------------------------------------


def _rules(spark):
    ids = spark.range(1, 25)
    kind = F.col("id") % 3
    return ids.select(
        "id", ((F.col("id") - 1) % 4 + 1).alias("project_id"), F.concat(F.lit("rule"), F.col("id").cast("string")).alias("name"),
        F.when(kind == 0, "new_issue").when(kind == 1, "regression").otherwise("frequency").alias("condition"), (F.col("id") * 3).alias("threshold"),
        F.when(F.col("id") == 20, "").otherwise("https://hooks.example.com").alias("webhook_url"), (F.col("id") % 7 != 0).alias("enabled"),
    )


_RULES = """rules AS (SELECT i AS id, (i - 1) % 4 + 1 AS project_id, 'rule' || i AS name, CASE i % 3 WHEN 0 THEN 'new_issue' WHEN 1 THEN 'regression' ELSE 'frequency' END AS condition, i * 3 AS threshold,
  CASE WHEN i = 20 THEN '' ELSE 'https://hooks.example.com' END AS webhook_url, i % 7 <> 0 AS enabled FROM range(1, 25) r(i))"""


def _activity(spark, sf_dir):
    return _timeline(spark, sf_dir).withColumnRenamed("target", "issue").withColumn("ts", F.timestamp_micros(F.floor(F.col("seen_at") / 1000)))


@_register(f"""{_BASE}, {_RULES} SELECT id AS rule_id, t.project_id, target AS issue, arrival_seq, times_seen FROM timeline t JOIN rules r ON r.project_id = t.project_id AND enabled
WHERE CASE condition WHEN 'new_issue' THEN is_new WHEN 'regression' THEN regressed ELSE threshold > 0 AND times_seen = threshold END""")
def alert_matches(spark, sf_dir):
    return alerts.match_rules(_activity(spark, sf_dir), _rules(spark)).select("rule_id", "project_id", "issue", "arrival_seq", "times_seen")


@_register(f"""WITH RECURSIVE {ERROR_EVENTS},
m AS (SELECT project_id, fingerprint AS issue, arrival_seq, ts_ns, row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY ts_ns, arrival_seq) AS n FROM error_events WHERE event_type = 'error'),
f AS (SELECT project_id, issue, arrival_seq, ts_ns, n FROM m WHERE n = 1 UNION ALL
  SELECT m.project_id, m.issue, m.arrival_seq, m.ts_ns, m.n FROM f JOIN m USING (project_id, issue) WHERE m.ts_ns - f.ts_ns >= {6 * HOUR}
  QUALIFY row_number() OVER (PARTITION BY m.project_id, m.issue ORDER BY m.n) = 1)
SELECT project_id, issue, arrival_seq FROM f""")
def alert_cooldown(spark, sf_dir):
    """Every error event matches; it fires unless the issue fired within six hours."""
    e = error_events(spark, sf_dir).where("event_type = 'error'")
    matches = e.select(F.lit(1).cast("bigint").alias("rule_id"), "project_id", F.col("fingerprint").alias("issue"), "arrival_seq", "ts")
    return alerts.cool_down(matches, 6 * 3600).select("project_id", "issue", "arrival_seq")


@_register(f"""{_BASE}, {_RULES},
m AS (SELECT r.id AS rule_id, r.name AS rule, r.condition, t.*, row_number() OVER (PARTITION BY r.id, t.project_id, t.target ORDER BY t.seen_at, t.arrival_seq) AS n FROM timeline t JOIN rules r ON r.project_id = t.project_id AND enabled
  WHERE CASE condition WHEN 'new_issue' THEN is_new WHEN 'regression' THEN regressed ELSE threshold > 0 AND times_seen = threshold END)
SELECT * FROM (WITH RECURSIVE f AS (SELECT * FROM m WHERE n = 1 UNION ALL
  SELECT m.* FROM f JOIN m ON m.rule_id = f.rule_id AND m.project_id = f.project_id AND m.target = f.target WHERE m.seen_at - f.seen_at >= {alerts.COOLDOWN_SECONDS * 10**9}
  QUALIFY row_number() OVER (PARTITION BY m.rule_id, m.project_id, m.target ORDER BY m.n) = 1)
SELECT rule_id, project_id, target AS issue, arrival_seq, rule, condition, target AS issue_id, title, level, status, times_seen FROM f)""")
def alert_firings(spark, sf_dir):
    """Matches after the cooldown, with the fields of their JSON payload."""
    fired = alerts.firings(_activity(spark, sf_dir), _rules(spark))
    fields = F.from_json("payload", "rule string, condition string, project_id bigint, issue_id string, title string, level string, status string, times_seen bigint").alias("p")
    return fired.select("rule_id", "issue", "arrival_seq", fields).select("rule_id", "issue", "arrival_seq", "p.*")


_CUSTOMER_RULES = """customer_rules AS (SELECT c_custkey AS id, c_nationkey % 4 + 1 AS project_id, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'new_issue' WHEN 'MACHINERY' THEN 'regression' WHEN 'HOUSEHOLD' THEN 'frequency' ELSE 'other' END AS condition,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://hooks.example.com/' || c_custkey END AS webhook_url, c_acctbal > 0 AS enabled FROM customer)"""


def _customer_rules(spark, sf_dir):
    """A rule of each customer; those who never ordered anything have deleted theirs."""
    c = table(spark, sf_dir, "customer")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    rules = c.select(
        key.alias("id"), (F.col("c_nationkey") % 4 + 1).alias("project_id"), F.when(key % 17 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(segment == "BUILDING", "new_issue").when(segment == "MACHINERY", "regression").when(segment == "HOUSEHOLD", "frequency").otherwise("other").alias("condition"),
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("https://hooks.example.com/"), key.cast("string"))).alias("webhook_url"), (F.col("c_acctbal") > 0).alias("enabled"),
    )
    return rules, c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(key.alias("id"))


@_register(f"WITH {_CUSTOMER_RULES} SELECT id, project_id, name, condition, enabled FROM customer_rules WHERE condition <> 'other' AND name <> '' AND webhook_url <> ''")
def alert_rules_valid(spark, sf_dir):
    """The rules whose definition holds."""
    return alerts.valid_rules(_customer_rules(spark, sf_dir)[0]).select("id", "project_id", "name", "condition", "enabled")


@_register(f"""WITH {_CUSTOMER_RULES} SELECT id, name FROM customer_rules WHERE project_id = 2 AND condition <> 'other' AND name <> '' AND webhook_url <> '' AND enabled
  AND id IN (SELECT o_custkey FROM orders) ORDER BY id LIMIT 100""")
def alert_rule_list(spark, sf_dir):
    """A project's enabled valid rules by id, without deleted ones."""
    rules, deleted = _customer_rules(spark, sf_dir)
    return alerts.list_rules(alerts.valid_rules(rules), 2, enabled_only=True, deleted=deleted).select("id", "name")


@_register(f"""WITH RECURSIVE {ERROR_EVENTS},
a AS (SELECT project_id, arrival_seq, ts_ns, row_number() OVER (PARTITION BY project_id ORDER BY ts_ns, arrival_seq) AS n, project_id * 0.0005::DOUBLE AS rate, 3::DOUBLE AS burst FROM error_events),
w AS (
  SELECT project_id, arrival_seq, ts_ns, n, true AS admitted, burst - 1 AS tokens FROM a WHERE n = 1 UNION ALL
  SELECT a.project_id, a.arrival_seq, a.ts_ns, a.n, least(a.burst, w.tokens + (a.ts_ns - w.ts_ns)::DOUBLE / 1e9::DOUBLE * a.rate) >= 1,
    least(a.burst, w.tokens + (a.ts_ns - w.ts_ns)::DOUBLE / 1e9::DOUBLE * a.rate) - CASE WHEN least(a.burst, w.tokens + (a.ts_ns - w.ts_ns)::DOUBLE / 1e9::DOUBLE * a.rate) >= 1 THEN 1 ELSE 0 END
  FROM w JOIN a ON a.project_id = w.project_id AND a.n = w.n + 1)
SELECT project_id, arrival_seq, admitted FROM w""")
def quota_admission(spark, sf_dir):
    """Token buckets of a few events an hour."""
    limits = spark.range(1, 5).select(F.col("id").alias("project_id"), (F.col("id") * F.lit(0.0005)).alias("per_second"), F.lit(3.0).alias("burst"))
    return quota.admit(error_events(spark, sf_dir), limits).select("project_id", "arrival_seq", "admitted")


# ---- access ---------------------------------------------------------------

_ROLE_NAMES = list(access.ROLES)
_ROLES = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', [{', '.join(repr(x) for x in p)}])" for r, p in access.ROLES.items()) + ") v(role, perms))"


@_register(f"""WITH {_ROLES}, u AS (SELECT c_custkey AS user_id, (c_nationkey % 2 + 1)::BIGINT AS org_id, [{', '.join(repr(r) for r in [*_ROLE_NAMES, 'guest'])}][(c_custkey % 7 + 1)::INT] AS role FROM customer),
t AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['event:read', 'org:read'] ELSE ['org:write', 'issue:read'] END AS allowed FROM orders
  WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 4 > 1))
SELECT t.id AS token_id, user_id, org_id, array_to_string(list_sort(CASE WHEN len(allowed) = 0 THEN coalesce(perms, []) ELSE list_intersect(coalesce(perms, []), allowed) END), ',') AS permissions
FROM t JOIN u USING (user_id) LEFT JOIN roles USING (role)""")
def effective_permissions(spark, sf_dir):
    """What live tokens may do: their owner's role, restricted to the token's own list."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    roles = F.array(*(F.lit(r) for r in [*_ROLE_NAMES, "guest"]))
    users = customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 2 + 1).cast("bigint").alias("org_id"), F.get(roles, (F.col("c_custkey") % 7).cast("int")).alias("role"))
    k, texts = F.col("o_orderkey"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    allowed = F.when(k % 3 == 0, texts()).when(k % 3 == 1, texts("event:read", "org:read")).otherwise(texts("org:write", "issue:read"))
    tokens = orders.select(k.alias("id"), F.col("o_custkey").alias("user_id"), allowed.alias("permissions"), ((k % 4) * 1000).alias("expires_at"), (k % 5 == 0).alias("revoked"))
    return access.effective_permissions(users, tokens, 1000).withColumn("permissions", F.array_join("permissions", ","))


@_register(f"WITH {ERROR_EVENTS}, {PROJECTS} SELECT arrival_seq, project_id, CAST(NULL AS VARCHAR) AS payload FROM error_events WHERE project_id IN (SELECT id FROM projects WHERE org_id = 1)")
def scoped_view(spark, sf_dir):
    """Events a read-only member of organisation 1 sees: its projects', without payloads."""
    e = error_events(spark, sf_dir).withColumn("payload", F.col("message"))
    return access.scoped_view(e, tables.projects(spark), 1, access.ROLES["read_only"]).select("arrival_seq", "project_id", "payload")


@_register(f"WITH {ERROR_EVENTS}, {PROJECTS} SELECT DISTINCT project_id FROM error_events WHERE project_id IN (SELECT id FROM projects WHERE org_id = 2)")
def projects_in_org(spark, sf_dir):
    return access.in_org(error_events(spark, sf_dir).select("project_id").distinct(), tables.projects(spark), 2)


@_register(f"""WITH {ERROR_EVENTS}, {PROJECTS}, {KEYS} SELECT p.id, p.name, coalesce((SELECT arg_min(public_key, k.id) FROM project_keys k WHERE k.project_id = p.id AND is_active), '') AS public_key, coalesce(n, 0) AS events
FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM error_events GROUP BY 1) c ON c.project_id = p.id WHERE org_id = 2""")
def project_list(spark, sf_dir):
    """Projects with their first active key and their number of events."""
    counts = error_events(spark, sf_dir).groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("events"))
    out = access.project_list(tables.projects(spark), tables.project_keys(spark), 2).join(counts, "id", "left")
    return out.select("id", "name", "public_key", F.coalesce("events", F.lit(0)).alias("events"))


@_register("SELECT id, \"at\", org_id FROM (SELECT event_id AS id, epoch_us(ts) AS \"at\", user_id % 2 + 1 AS org_id FROM events) WHERE org_id = 1 ORDER BY \"at\" DESC, id DESC LIMIT 200")
def audit_trail(spark, sf_dir):
    """An append-only trail of all events' users, read back newest first."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("user_id") % 2 + 1).alias("org_id"))
    path = store.scratch_path(spark, "audit")
    access.append_audit(rows.where("id % 2 = 0"), path)
    access.append_audit(rows.where("id % 2 = 1"), path)
    return access.audit_trail(spark.read.parquet(path), 1)
