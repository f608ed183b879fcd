"""Routing of records to projects, nearest neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def nearest(rows: DataFrame, by: str, ts: str, key: str, known: Column, value: Column, hours: int = 12) -> DataFrame:
    """Rows without a value take that of their neighbours in time, where both sides (or the only one) within ``hours`` agree."""
    w = Window.partitionBy(by).orderBy(ts, key)
    mark = F.when(known, F.struct(F.col(ts).alias("t"), value.alias("v")))
    own = rows.withColumn("_before", F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    near = F.lit(hours * 3600)
    before = F.when(F.unix_timestamp(ts) - F.unix_timestamp("_before.t") <= near, F.col("_before.v"))
    after = F.when(F.unix_timestamp("_after.t") - F.unix_timestamp(ts) <= near, F.col("_after.v"))
    lent = F.when(before.isNull() | after.isNull() | (before == after), F.coalesce(before, after))
    return own.withColumn("routed", F.when(known, value).otherwise(lent)).drop("_before", "_after")


def within(rows: DataFrame, starts: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Rows within ``seconds`` of a start (by, start) of their group."""
    return rows.join(starts, by).where(F.abs(F.unix_timestamp(ts) - F.unix_timestamp("start")) <= seconds)


def _terms(rows: DataFrame, key: str) -> DataFrame:
    """(key, term); explode_outer, as Spark would split each text twice to leave out those without terms before explode."""
    return rows.select(key, F.explode_outer(T.terms(F.col("text"))).alias("term")).where("term is not null")


def scores(rows: DataFrame, projects: DataFrame, min_score: float = 2.0, margin: float = 1.5) -> DataFrame:
    """Rows (id, text) against projects (project, text) by shared terms over the number of projects that have them.

    A term is one row with its projects, so rows meet a term once, and texts are split once.
    """
    own = _terms(projects, "project").groupBy("term", "project").agg(F.count("*").alias("n"))
    held = own.groupBy("term").agg(F.collect_list(F.struct("project", "n")).alias("own"))  # at most an entry a project
    pairs = _terms(rows, "id").join(held, "term").select("id", F.size("own").alias("df"), F.inline("own"))
    weight = F.when(F.col("n") == 1, 0.4).when(F.col("n") == 2, 0.7).otherwise(1.0) / F.col("df")
    s = pairs.groupBy("id", "project").agg(F.round(F.sum(weight), 6).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "project")
    ranked = s.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("rank = 1")
    return ranked.select("id", "project", "score", ((F.col("score") >= min_score) & (F.col("score") >= margin * F.coalesce("second", F.lit(0.0)))).alias("confident"))
