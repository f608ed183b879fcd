"""Co-change and hotspots from commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FILES, TOP = 30, 5


def co_change(files: DataFrame, least: float = 0.25, min_pairs: int = 2) -> DataFrame:
    """(a, b, n, score): files that change together; kept if among the best five of either.

    A commit has at most MAX_FILES files, so it gives a bounded number of pairs.
    """
    small = files.join(files.groupBy("sha").agg(F.count("*").alias("_n")).where(F.col("_n") <= MAX_FILES).select("sha"), "sha", "left_semi").select("sha", "path")
    single = small.groupBy("path").agg(F.count("*").alias("n"))
    a, b = small.select("sha", F.col("path").alias("a")), small.select("sha", F.col("path").alias("b"))
    pairs = a.join(b, "sha").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pairs)
    s = pairs.join(single.select(F.col("path").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("path").alias("b"), F.col("n").alias("n_b")), "b")
    s = s.withColumn("score", F.col("n") / F.sqrt(F.col("n_a") * F.col("n_b"))).where(F.col("score") >= least)
    both = s.select("a", "b", "n", "score", F.col("a").alias("own"), F.col("b").alias("other")).unionByName(s.select("a", "b", "n", "score", F.col("b").alias("own"), F.col("a").alias("other")))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.desc("other"), F.desc("n")))).where(F.col("_r") <= TOP)
    return best.groupBy("a", "b").agg(F.max("n").alias("n"), F.round(F.max("score"), 3).alias("score"))


def hotspots(commits: DataFrame, files: DataFrame, ranks: DataFrame, limit: int) -> DataFrame:
    """A10: ln(1 + commits) * ln(1 + churn) * (0.3 + rank / greatest rank), files of two commits or more."""
    used = files.join(commits.select("sha"), "sha").groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn")).where("commits >= 2")
    most = ranks.agg(F.max("rank").alias("most"))
    s = used.join(ranks, "path").crossJoin(F.broadcast(most))  # one row
    score = F.round(F.log1p("commits") * F.log1p("churn") * (0.3 + F.col("rank") / F.col("most")), 6)
    return s.select("path", "commits", F.col("churn").cast("long").alias("churn"), score.alias("score")).orderBy(F.desc("score"), "path").limit(limit)
