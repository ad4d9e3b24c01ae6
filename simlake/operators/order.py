"""Numbers and running sums over a whole table, without one task that reads it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simlake.operators.runtime import checkpoint


def running_total(df: DataFrame, order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (1 by default) over all rows up to each, in the order of ``order``.

    Ranges of the order go to tasks; each sums its own, and the sums of the ranges before, one row a range, are added.
    """
    value = F.lit(1).cast("long") if value is None else value
    ranged = checkpoint(df.withColumn("~value", value).repartitionByRange(*order).withColumn("~part", F.spark_partition_id()))
    sums = ranged.groupBy("~part").agg(F.sum("~value").alias("~sum"))
    before = sums.withColumn("~before", F.sum("~sum").over(Window.orderBy("~part").rowsBetween(Window.unboundedPreceding, -1)))
    up_to = F.sum("~value").over(Window.partitionBy("~part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = ranged.join(F.broadcast(before.select("~part", "~before")), "~part")
    return joined.withColumn(name, up_to + F.coalesce("~before", F.lit(0))).drop("~value", "~part", "~before")


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in the order of ``order``; rows that tie get theirs in any order."""
    return running_total(df, order, name).withColumn(name, F.col(name) + (first - 1))
