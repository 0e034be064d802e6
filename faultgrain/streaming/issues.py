"""Issues on a stream of hits and commands, with merges and splits.

Each micro-batch advances the issues it touches with the batch operator, so a
stream's outcomes are those of its log taken whole. Batches must come in
arrival order.

The issue table is a log-structured one: a directory for each bucket of
(project, fingerprint), where a batch appends only the rows it changed, and an
issue is its row of the last batch. A batch opens the buckets of what it names
and of what is merged with that (merges, which people make, are found through a
table of their own). A bucket that holds more than ``DELTAS`` appends is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.issues import ISSUES, advance
from ..schema import COMMAND, HIT
from ..sources import store, versions

#: Columns of the stream: hits have a null kind, commands have null hit columns.
ROW = f"{HIT}, " + ", ".join(c for c in COMMAND.split(", ") if c.split()[0] not in {h.split()[0] for h in HIT.split(", ")})
STORED = f"{ISSUES}, batch bigint, bucket int"
OUTCOMES = f"{HIT}, target string, is_new boolean, regressed boolean, times_seen bigint, status string, seen_date date"
MERGES = "project_id bigint, fingerprint string, merged_into string, batch bigint, part int"
BUCKETS = 64
DELTAS = 16
WRITER = "issues"
_KEY = ["project_id", "fingerprint"]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def log_rows(hits: DataFrame, commands: DataFrame) -> DataFrame:
    """Hits and commands as rows of one log."""
    return hits.unionByName(commands, allowMissingColumns=True).select(*_names(ROW))


def bucket(project_id: Column, fingerprint: Column) -> Column:
    return F.pmod(F.xxhash64(project_id, fingerprint), F.lit(BUCKETS)).cast("int")


def _last(rows: DataFrame) -> DataFrame:
    """Each issue's row of the last batch."""
    value = F.struct(*(c for c in _names(STORED) if c not in _KEY))
    return rows.groupBy(*_KEY).agg(F.max_by(value, "batch").alias("v")).select(*_KEY, "v.*").select(*_names(STORED))


def current_issues(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame:
    """The issue table after the last batch, or some buckets of it."""
    keep = None if buckets is None else lambda name: int(name.removeprefix("bucket=")) in buckets
    return _last(versions.read(spark, f"{path}/issues", STORED, keep=keep)).select(*_names(ISSUES))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcome of every hit so far."""
    return versions.read(spark, f"{path}/outcomes", OUTCOMES).drop("seen_date")


def _merges(spark: SparkSession, path: str, before: int) -> DataFrame:
    """(project_id, fingerprint, merged_into) of issues that were merged when batch ``before`` began."""
    rows = versions.read(spark, f"{path}/merges", MERGES).where(F.col("batch") < before)
    return rows.groupBy(*_KEY).agg(F.max_by("merged_into", "batch").alias("merged_into")).where("merged_into is not null")


def issues_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Append the outcomes of a batch of ``log_rows`` and the issues it changed under ``path``; a batch that is done is left alone."""
    spark = rows.sparkSession
    if versions.is_done(spark, f"{path}/issues", WRITER, batch_id):
        return
    with store.scratch(spark):
        rows = store.kept(rows, "log")
        hits, commands = rows.where("kind is null").select(*_names(HIT)), rows.where("kind is not null").select(*_names(COMMAND))
        more = F.explode(F.array_compact(F.concat(F.array("fingerprint", "target"), F.coalesce("sources", F.array().cast("array<string>")))))
        named = hits.select(*_KEY).union(commands.select("project_id", more.alias("fingerprint"))).distinct()
        # What is merged into a named issue, and what a named one is merged into.
        merges = _merges(spark, path, batch_id)
        sources = merges.join(named.select("project_id", F.col("fingerprint").alias("merged_into")), ["project_id", "merged_into"], "left_semi").select(*_KEY)
        targets = merges.join(named, _KEY, "left_semi").select("project_id", F.col("merged_into").alias("fingerprint"))
        touched = store.kept(named.union(sources).union(targets).distinct().withColumn("bucket", bucket(F.col("project_id"), F.col("fingerprint"))), "touched")
        buckets = {r["bucket"] for r in touched.select("bucket").distinct().collect()}  # at most BUCKETS
        before = store.kept(current_issues(spark, path, buckets).join(touched.select(*_KEY), _KEY, "left_semi"), "before")
        line, after = advance(before, hits, commands)
        versions.append_rows(line.select(*_names(OUTCOMES)[:-1], store.event_date(F.col("seen_at")).alias("seen_date")), f"{path}/outcomes", "seen_date", writer=WRITER, batch=batch_id)
        after = store.kept(after, "after")
        both = after.select(*_KEY, "merged_into").join(before.select(*_KEY, F.col("merged_into").alias("_was")), _KEY, "left")
        changed = both.where(~F.col("merged_into").eqNullSafe(F.col("_was"))).select(*_KEY, "merged_into", F.lit(batch_id).cast("bigint").alias("batch"), F.lit(0).alias("part"))
        versions.append_rows(changed.coalesce(1), f"{path}/merges", "part", writer=WRITER, batch=batch_id)
        changed = after.select(*_names(ISSUES), F.lit(batch_id).cast("bigint").alias("batch"), bucket(F.col("project_id"), F.col("fingerprint")).alias("bucket"))
        changed = changed.join(before.select(*(F.col(c).alias(f"_{c}") if c not in _KEY else F.col(c) for c in _names(ISSUES)), F.lit(True).alias("_old")), _KEY, "left")
        same = F.coalesce("_old", F.lit(False))
        for c in _names(ISSUES):
            if c not in _KEY:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        changed = changed.where(~same).select(*_names(STORED))
        versions.append_rows(changed.hint("rebalance", F.col("bucket")), f"{path}/issues", "bucket", writer=WRITER, batch=batch_id)
        versions.fold(spark, f"{path}/issues", STORED, "bucket", beyond=DELTAS, merge=_last)


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 86400) -> int:
    """Free what folds and failed batches left."""
    return sum(versions.vacuum(spark, f"{path}/{name}", keep_seconds) for name in ("issues", "merges", "outcomes"))


def start_issues(rows: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Run on a stream of ``log_rows``; ``once`` ends when all available data are done."""
    writer = rows.writeStream.foreachBatch(lambda df, batch: issues_batch(df, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
