"""Running totals over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint, for a small table that one plan reads several times. In the session's
    spark.checkpoint.dir; in one of our own only where that is unset and no other machine takes part."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file:///tmp/lattica-shared")
    return df.checkpoint()


def before(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """df with, for each (out, column) of `totals`, the column's sum over all rows that come earlier in `order`.

    Rows are dealt in ranges of the order, which has to be total; windows run within a range, and once over one row a
    range. The dealt rows are checkpointed, so that a row's range stays the same wherever it is read."""
    dealt = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{out}") for out, c in totals.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_range"), *(F.coalesce(F.sum(f"_{out}").over(earlier), F.lit(0)).alias(f"_{out}") for out in totals))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select("*", *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(out) for out, c in totals.items())).join(F.broadcast(starts), "_range")  # a row a range
    return placed.withColumns({out: F.col(out) + F.col(f"_{out}") for out in totals}).drop("_range", *(f"_{out}" for out in totals))
