"""Counts that show that nothing is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HOUR_NS, bucket_start


class Unaccounted(RuntimeError):
    """Items went in that were neither stored nor rejected."""


def drops_by_reason(classified: DataFrame) -> DataFrame:
    return classified.where("reason is not null").groupBy("reason").agg(F.count("*").alias("count"))


def lag(records: DataFrame, classified: DataFrame) -> DataFrame:
    """One row ``lag``: records that arrived and are not classified yet."""
    return records.join(classified.select("arrival_seq").distinct(), "arrival_seq", "left_anti").agg(F.count("*").alias("lag"))


def ingest_status(records: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: records received, events stored, items dropped, records that wait, (project, hour) segments of what is stored."""
    one = F.lit(1).alias("_k")
    segment = F.when(F.col("reason").isNull(), F.struct("project_id", bucket_start(F.col("ts_ns"), HOUR_NS)))
    out = classified.agg(F.count_if(F.col("reason").isNull()).alias("stored"), F.count_if(F.col("reason").isNotNull()).alias("dropped"), F.count_distinct(segment).alias("segments"))
    received = records.agg(F.count("*").alias("received")).select("*", one)
    return received.join(out.select("*", one), "_k").join(lag(records, classified).select("*", one), "_k").drop("_k")


def accounting(items_in: DataFrame, stored: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row (items_in, stored, rejected, missing)."""
    count = lambda df, name: df.agg(F.count("*").alias(name)).select("*", F.lit(1).alias("_k"))
    out = count(items_in, "items_in").join(count(stored, "stored"), "_k").join(count(rejected, "rejected"), "_k")
    return out.select("items_in", "stored", "rejected", (F.col("items_in") - F.col("stored") - F.col("rejected")).alias("missing"))


def require_accounted(items_in: DataFrame, stored: DataFrame, rejected: DataFrame) -> None:
    row = accounting(items_in, stored, rejected).collect()[0]
    if row["missing"]:
        raise Unaccounted(str(row.asDict()))


def consumer_lag(progress: dict | None) -> dict[str, float]:
    """Of a streaming query's last progress: rows of the batch, rates, and by how many rows a second it falls behind."""
    progress = progress or {}
    came, done = progress.get("inputRowsPerSecond") or 0.0, progress.get("processedRowsPerSecond") or 0.0
    return {"rows": progress.get("numInputRows", 0), "in_per_second": came, "out_per_second": done, "behind_per_second": max(0.0, came - done)}
