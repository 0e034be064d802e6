"""The ingest job on a stream: each micro-batch is classified, written and accounted for.

A batch appends to the event table, to the hits of issues, to rejects and to the
ids seen. Each table has a log of versions that knows the last batch of the
stream, so a batch that is run again after a failure adds only what is missing,
also after compaction. Ids come last: where they are in, all is. Sources are
bounded per batch by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` of the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.ops import require_accounted
from ..schema import HIT, RECORD
from ..sources.ingest import classify, issue_hits, mark_duplicates
from ..sources import store, versions
from .state import first_arrivals

ID_DAYS = 1
#: Tables by received_date next to the event table.
SCHEMAS = {
    "hits": f"{HIT}, received_date date",
    "rejects": "arrival_seq bigint, received_at timestamp, project_id bigint, item_no int, reason string, batch_id bigint, received_date date",
    "ids": "project_id bigint, event_id string, batch_id bigint, received_date date",
}


def landing_stream(spark: SparkSession, path: str, *, files_per_batch: int = 0, bytes_per_batch: int = 0) -> DataFrame:
    """Raw records that land as Parquet files; every consumer replays from its own checkpoint."""
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The events, hits, rejects or ids that an ingest under ``path`` has stored."""
    return store.read_events(spark, f"{path}/events") if name == "events" else versions.read(spark, f"{path}/{name}", SCHEMAS[name])


def compact(spark: SparkSession, path: str) -> None:
    """Fold the batches of each day in all four tables; the stream may run meanwhile."""
    store.compact(spark, f"{path}/events")
    for name, schema in SCHEMAS.items():
        versions.fold(spark, f"{path}/{name}", schema, "received_date")


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 86400) -> int:
    """Free what compaction and failed batches left."""
    return store.vacuum(spark, f"{path}/events", keep_seconds) + sum(versions.vacuum(spark, f"{path}/{name}", keep_seconds) for name in SCHEMAS)


def _seen_before(spark: SparkSession, path: str, batch_id: int, low: str, high: str) -> DataFrame:
    """Ids that other batches stored on the days from ``low`` to ``high``."""
    near = lambda name: low <= name.removeprefix("received_date=") <= high
    return versions.read(spark, path, SCHEMAS["ids"], keep=near).where(F.col("batch_id") != batch_id).select("project_id", "event_id").distinct()


def ingest_batch(records: DataFrame, batch_id: int, keys: DataFrame, path: str, writer: str = "ingest") -> None:
    """Classify one batch and append to ``events``, ``hits``, ``rejects`` and ``ids`` under ``path``; fail if an item is unaccounted for.

    ``writer`` names the stream; its batches come in order of their ids.
    """
    spark = records.sparkSession
    if versions.is_done(spark, f"{path}/ids", writer, batch_id):
        return
    everything = classify(records, keys).persist()
    days = F.date_sub(F.to_date(F.min("received_at")), ID_DAYS), F.to_date(F.max("received_at"))
    span = everything.agg(*(d.cast("string").alias(name) for d, name in zip(days, ("low", "high"), strict=True))).collect()[0]
    rows = mark_duplicates(everything)
    seen = _seen_before(spark, f"{path}/ids", batch_id, span["low"], span["high"]) if span["low"] else None
    if seen is not None:
        rows = rows.join(seen.withColumn("_seen", F.lit(True)), ["project_id", "event_id"], "left")
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_seen"), "duplicate").otherwise(F.col("reason"))).drop("_seen")
    rows = rows.persist()
    _append(rows, batch_id, path, writer, ids=True)
    require_accounted(everything, rows.where("reason is null"), rows.where("reason is not null"))
    rows.unpersist()
    everything.unpersist()


def _append(rows: DataFrame, batch_id: int, path: str, writer: str, ids: bool) -> None:
    """Append a batch's events, hits, rejects and, last, ids."""
    rows = rows.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "received_date": F.to_date("received_at")})
    new = rows.where("reason is null")
    store.write_events(new, f"{path}/events", writer=writer, batch=batch_id)
    parts = {
        "hits": issue_hits(new, "received_date"),
        "rejects": rows.where("reason is not null").select("arrival_seq", "received_at", "project_id", "item_no", "reason", "batch_id", "received_date"),
    }
    if ids:
        parts["ids"] = new.where("event_id <> ''").select("project_id", "event_id", "batch_id", "received_date")
    for name, part in parts.items():
        versions.append_rows(part, f"{path}/{name}", "received_date", writer=writer, batch=batch_id)


def start_keyed_ingest(records: DataFrame, keys: DataFrame, path: str, checkpoint: str, *, hold: str = "1 day", delay: str = "10 minutes", once: bool = False) -> StreamingQuery:
    """The ingest with the ids seen in keyed state instead of a table.

    An id is held for ``hold`` after its first arrival, by the watermark of
    received_at, so the state is that of a window and no batch reads what others
    stored. A batch that runs again gives what it gave, and the tables take it once.
    """
    rows = first_arrivals(classify(records, keys), hold, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not versions.is_done(batch.sparkSession, f"{path}/rejects", "keyed", batch_id):
            batch = batch.persist()
            _append(batch, batch_id, path, "keyed", ids=False)
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_ingest(records: DataFrame, keys: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Run the ingest on a stream of records; ``once`` ends when all available data are done."""
    writer: DataStreamWriter = records.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, keys, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drop_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of ``events(ts, project_id, event_id)`` without repeats inside the watermark; empty ids pass."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.where("event_id <> ''").dropDuplicatesWithinWatermark(["project_id", "event_id"]).unionByName(marked.where("event_id = ''"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(project_id, start, count) of a stream; rows later than the watermark no longer change a closed window."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = marked.groupBy(F.window("ts", width).alias("w"), "project_id").agg(F.count("*").alias("count"))
    return counts.select("project_id", F.col("w.start").alias("start"), "count")
