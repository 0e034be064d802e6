"""Running values over long ordered groups, without putting a group in one task.

A group's rows are cut into slices of its order column; each slice is a window
of its own, and totals of the slices before, one row each, are carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 20


def running(df: DataFrame, keys: list[str], seq: str, sums: dict[str, Column], lasts: dict[str, Column] | None = None, width: int = SLICE) -> DataFrame:
    """``df`` with running sums that include the row, and last non-null values of the rows before it."""
    lasts = lasts or {}
    names = [*sums, *lasts]
    values = {f"_v_{n}": c for n, c in (sums | lasts).items()}
    sliced = df.withColumns(values | {"_slice": F.floor(F.col(seq) / width)})
    here = [*keys, "_slice"]
    totals = sliced.groupBy(*here).agg(
        *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums),
        *(F.max_by(F.struct(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(seq))).alias(f"_t_{n}") for n in lasts),
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *here,
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums),
        *(F.last(F.col(f"_t_{n}._v_{n}"), ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts),
    )
    order = Window.partitionBy(*here).orderBy(seq)
    upto, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumns(
        {f"_i_{n}": F.sum(f"_v_{n}").over(upto) for n in sums} | {f"_i_{n}": F.last(F.col(f"_v_{n}"), ignorenulls=True).over(above) for n in lasts}
    )
    out = inside.join(carried, here)
    out = out.withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in sums} | {n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in lasts})
    return out.drop("_slice", *values, *(f"_{p}_{n}" for p in "ic" for n in names))


def sliced(df: DataFrame, keys: list[str], at: str, unit: int, rows: int) -> DataFrame:
    """``df`` with a number ``_slice`` that cuts each key's rows by time into pieces of at most ``rows`` rows.

    The width is a multiple of ``unit``, the same for all keys, from the fullest
    unit of any key; only a unit that is itself fuller makes a larger piece.
    """
    slot = F.floor(F.col(at) / unit).alias("_slot")
    fullest = df.groupBy(*keys, slot).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 1
    return df.withColumn("_slice", F.floor(F.col(at) / (unit * max(1, rows // fullest))))


def dealt(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of each of ``keys`` together in one partition, one key after the other, in order.

    They are dealt by a hash of the keys, as Spark leaves out a repartition by the very keys of a join below it
    and then may run that join as a broadcast one, which deals nothing.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
