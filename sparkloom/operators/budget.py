"""Packing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(rows: DataFrame, by: str, order: list[str], cost: Column, budget: int) -> DataFrame:
    """In order, take what still fits and skip what does not; one group's costs must fit in a task."""
    item = F.struct(*order, cost.cast("long").alias("_cost"))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))
    step = F.aggregate("_all", start, lambda a, x: F.when(a["used"] + x["_cost"] <= budget, F.struct((a["used"] + x["_cost"]).alias("used"), (a["kept"] + 1).alias("kept"))).otherwise(a))
    return listed.withColumn("_r", step).select(by, F.size("_all").cast("long").alias("n"), F.col("_r.kept").alias("kept"), F.col("_r.used").alias("used"))


def prefix(rows: DataFrame, by: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest prefix within the budget."""
    run = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", run.cast("long")).where(F.col("running") <= budget)
