"""Consumers of a landing folder: how far each has read, what waits, and what may go.

A consumer is a streaming query on the folder's files. What it has done for
good is in its checkpoint: the source's log of files, up to the offset of the
last committed batch. So lag and retention hold for queries that run, that
stopped, and that other drivers run.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..schema import RECORD
from ..sources import store, versions


def _text(spark: SparkSession, path: str) -> str:
    files, at = versions.file_system(spark, path)
    stream = files.open(at(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def committed_offset(spark: SparkSession, checkpoint: str, source: int = 0) -> int:
    """The offset of a file source after the last committed batch; -1 before the first."""
    done = [int(name) for name, _ in versions._children(spark, f"{checkpoint}/commits") if name.isdigit()]
    if not done:
        return -1
    offsets = _text(spark, f"{checkpoint}/offsets/{max(done)}").splitlines()[2:]  # after its version and metadata
    return -1 if offsets[source] == "-" else int(json.loads(offsets[source])["logOffset"])


def _name(url: Column) -> Column:
    """A file's name, written alike by the source's log and by a scan."""
    return F.regexp_replace(F.url_decode(url), "^file:/+", "file:/")


def consumed_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """(file) of every file that committed batches have read."""
    upto = committed_offset(spark, checkpoint, source)
    if upto < 0:
        return spark.createDataFrame([], "file string")
    lines = spark.read.text(f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{"))
    entry = F.from_json("value", "path string, batchId bigint")
    return lines.select(entry.alias("e")).where(F.col("e.batchId") <= upto).select(_name(F.col("e.path")).alias("file")).distinct()


def landed_files(spark: SparkSession, landing: str, schema: str = RECORD) -> DataFrame:
    """(file, directory, bytes, records, landed_at) of the files in a landing folder that hold records, counted from what the files say of themselves."""
    about = spark.read.schema(schema).parquet(landing).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    rows = about.groupBy(_name(F.col("file_path")).alias("file")).agg(
        F.first("file_size").alias("bytes"), F.count("*").alias("records"), F.first("file_modification_time").alias("landed_at")
    )
    return rows.select("file", F.regexp_replace("file", "/[^/]*$", "").alias("directory"), "bytes", "records", "landed_at")


def _waiting(spark: SparkSession, landed: DataFrame, consumers: dict[str, str]) -> DataFrame:
    """Landed files that a consumer has not read, with its name."""
    out = None
    for name, checkpoint in sorted(consumers.items()):
        own = landed.join(consumed_files(spark, checkpoint), "file", "left_anti").withColumn("consumer", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return landed.withColumn("consumer", F.lit("")).where(F.lit(False)) if out is None else out


def lag(spark: SparkSession, landing: str, consumers: dict[str, str]) -> DataFrame:
    """(consumer, files, bytes, records) that wait for each of ``consumers`` (name to checkpoint); zeros where none does."""
    names = spark.createDataFrame([(n,) for n in sorted(consumers)], "consumer string")
    found = _waiting(spark, landed_files(spark, landing), consumers).groupBy("consumer").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
    return names.join(found, "consumer", "left").na.fill(0)


def drop_consumed(spark: SparkSession, landing: str, consumers: dict[str, str], *, now_ns: int, max_bytes: int = 0, max_age_ns: int = 0) -> list[str]:
    """Delete landed directories that retention wants gone and every consumer has read; their names.

    Directories go whole and oldest (by name) first, as ``store.expired`` says:
    while the rest is over ``max_bytes`` or they are older than ``max_age_ns``. The
    first one that holds a file which some consumer has not read ends it, and
    the last one stays. Without a consumer nothing goes.
    """
    landed = landed_files(spark, landing)
    unread = _waiting(spark, landed, consumers).groupBy("directory").agg(F.lit(1).alias("unread"))
    sizes = landed.groupBy("directory").agg(F.sum("bytes").alias("bytes"), (F.unix_micros(F.max("landed_at")) * 1000).alias("newest_ns"))
    segments = sizes.join(unread, "directory", "left").select(F.col("directory").alias("segment"), "bytes", "newest_ns", F.coalesce("unread", F.lit(0)).alias("end_offset"))
    gone = store.expired(segments, now_ns=now_ns, max_bytes=max_bytes, max_age_ns=max_age_ns, min_offset=0)
    names = sorted(r["segment"] for r in gone.select("segment").collect()) if consumers else []
    for name in names:  # one call a directory
        versions.delete(spark, name)
    return names


class Progress(StreamingQueryListener):
    """Keeps what each batch of the session's queries did: rows in, rates, state rows, watermark."""

    def __init__(self, most: int = 10_000) -> None:
        self.most, self.batches = most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({
            "query": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "in_per_second": p.inputRowsPerSecond, "out_per_second": p.processedRowsPerSecond,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "watermark": p.eventTime.get("watermark"), "at": p.timestamp,
        })
        del self.batches[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
