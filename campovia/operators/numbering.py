"""Running numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.session import durable


def numbered(df: DataFrame, order: list[str], name: str, step: Column | None = None) -> DataFrame:
    """df with the sum of step (by default 1) over all rows before this one, in the given order, as a whole number in column name.

    Rows are dealt by ranges of the order and written, each with its range; the ranges' totals (one row a range) are summed and
    joined back, and a window runs within each range alone. The order should tell all rows apart: rows equal in it fall into one range.
    """
    step = F.lit(1) if step is None else step
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.withColumn("_step", step.cast("long")).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum("_step").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("_start") + F.coalesce(F.sum("_step").over(within), F.lit(0))
    return dealt.join(F.broadcast(starts), "_range").select(*df.columns, place.cast("long").alias(name))
