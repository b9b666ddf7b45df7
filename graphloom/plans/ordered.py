"""Global orders without one task over all rows: range partitions, work in each, and what is carried from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.fixpoint import cut

PART = "__part"


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``__part``: every row of a part comes before every row of the next; rows equal in ``order`` share a part."""
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def parts_of(parted: DataFrame, *aggregates: Column) -> DataFrame:
    """One row a part (as many as shuffle partitions, so windows over them and broadcasts of them stay small)."""
    return parted.groupBy(PART).agg(*aggregates)


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with its row number from 1 in the order, and the number of all rows as ``total``; ``order`` should tell rows apart."""
    parted = ranged(df, *order)
    every, before = Window.orderBy(PART), "__before"
    start = parts_of(parted, F.count("*").alias("__n")).select(
        PART, (F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias(before), F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    out = parted.join(F.broadcast(start), PART).withColumn(name, (F.col(before) + F.row_number().over(Window.partitionBy(PART).orderBy(*order))).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop(PART, before, "__all")


def numbered_within(df: DataFrame, group: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with its row number from 1 among the rows of its group, in the order; a group of any size goes over as many tasks as it needs."""
    parted = ranged(df, group, *order)
    counts = parted.groupBy(PART, group).agg(F.count("*").alias("__n"))
    start = counts.select(F.col(PART).alias("__p"), F.col(group).alias("__g"), F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = parted.join(start, (F.col(PART) == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return out.withColumn(name, (F.col("__before") + F.row_number().over(Window.partitionBy(PART, group).orderBy(*order))).cast("long")).drop(PART, "__p", "__g", "__before")


def last_and_next(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``: the value that isn't null of the last row with a key at or below, and of the first row with one above or equal behind it.

    ``at`` breaks ties of the key: smaller ones come first.  An as-of join, given the union of both sides.
    """
    parted = ranged(rows, key)
    place = F.struct(key, at)
    ends = parts_of(parted, F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("__last"), F.min_by(value, F.when(F.col(value).isNotNull(), place)).alias("__first"))
    every = Window.orderBy(PART)
    carried = ends.select(PART, F.last("__last", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("__lo"), F.first("__first", ignorenulls=True).over(every.rowsBetween(1, Window.unboundedFollowing)).alias("__hi"))
    # both frames grow from the start of an order: one that shrinks towards the end is read anew for every row
    last = F.last(value, ignorenulls=True)
    lo = F.coalesce(last.over(Window.partitionBy(PART).orderBy(key, at).rowsBetween(Window.unboundedPreceding, 0)), F.col("__lo"))
    hi = F.coalesce(last.over(Window.partitionBy(PART).orderBy(F.desc(key), F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)), F.col("__hi"))
    return parted.join(F.broadcast(carried), PART).withColumns({"lo": lo, "hi": hi}).drop(PART, "__lo", "__hi")
