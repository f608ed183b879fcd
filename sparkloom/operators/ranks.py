"""Exact ranks, percentiles and running sums without a task for a whole group.

Rows are dealt by ranges of (group, order), so a group that holds most of the rows is
spread over many tasks. Each task numbers its own rows; the sums of the tasks before it
in the same group, a row for each task and group, are added.

Defined results: nulls come first, as in Spark's ascending order; rows that agree in
all order columns are numbered in any order; a null group is a group; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import store


def running(rows: DataFrame, by: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows of the group up to this one."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_amount", amount).repartitionByRange(n, *by, *order).withColumn("_task", F.spark_partition_id())
    dealt = store(dealt, "ranges")  # the ranges are sampled once
    own = Window.partitionBy("_task", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("_sum", F.sum("_amount").over(own))
    per_task = dealt.groupBy("_task", *by).agg(F.sum("_amount").alias("_part"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    offsets = offsets.select(F.col("_task").alias("_t"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "_before")
    on = F.col("_task") == F.col("_t")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return inside.join(offsets, on).withColumn(name, F.col("_sum") + F.col("_before")).drop("_t", "_task", "_amount", "_sum", "_before", *[f"_b{i}" for i in range(len(by))])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their places from 1 in each group."""
    return running(rows, by, order, F.lit(1).cast("long"), name)


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, p): of the n sorted values of each group that at place share * (n - 1), rounded half to even, from 0; nulls do not count."""
    used = rows.where(F.col(value).isNotNull()).select(by, value)
    n = used.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    placed = numbered(used, [by], [value], "_place").join(n, F.col(by).eqNullSafe(F.col("_by")))
    return placed.where(F.col("_place") - 1 == F.bround(share * (F.col("_n") - 1), 0).cast("long")).select(by, F.col(value).alias("p"))


def median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value of each group, of two the mean; nulls do not count."""
    used = rows.where(F.col(value).isNotNull()).select(by, value)
    n = used.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    placed = numbered(used, [by], [value], "_place").join(n, F.col(by).eqNullSafe(F.col("_by")))
    middle = placed.where((F.col("_place") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_place") == F.floor(F.col("_n") / 2) + 1))
    return middle.groupBy(by).agg(F.avg(value).alias("median"))


def share_below(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, below): the share of all rows whose value is strictly smaller."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    upto = running(counts, [], [value], F.col("_n"), "_upto")
    total = rows.agg(F.count("*").alias("_total"))  # one row
    below = upto.select(F.col(value).alias("_v"), (F.col("_upto") - F.col("_n")).alias("_below")).crossJoin(F.broadcast(total))
    return rows.join(below, F.col(value).eqNullSafe(F.col("_v"))).select(key, (F.col("_below") / F.col("_total")).alias("below"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree): how many edges each node has; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
