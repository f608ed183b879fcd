"""Folding long outputs and unfolding them exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEAD, TAIL, SALIENT_MAX, BUDGET = 40, 20, 30, 6000


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line, total)."""
    own = docs.select(F.col(id_col).alias("id"), T.lines(F.col(text_col)).alias("l"))
    return own.select("id", F.size("l").cast("long").alias("total"), F.posexplode("l").alias("p", "line")).select("id", (F.col("p") + 1).cast("long").alias("line_no"), "line", "total")


def preview(lines: DataFrame, head: int = HEAD, tail: int = TAIL, budget: int = BUDGET) -> DataFrame:
    """L1: head, salient middle and tail lines of each body, each part within its share of the budget.

    A part stops at the first line that overflows; head and tail keep one line.
    """
    cost = F.length(T.cut_line(F.col("line"))) + 1
    down, up = Window.partitionBy("id").orderBy("line_no"), Window.partitionBy("id").orderBy(F.desc("line_no"))
    far = (Window.unboundedPreceding, 0)
    own = lines.withColumn("cost", cost).withColumn("from_top", F.sum("cost").over(down.rowsBetween(*far))).withColumn("from_end", F.sum("cost").over(up.rowsBetween(*far)))
    place = F.col("total") - F.col("line_no") + 1
    in_head = (F.col("line_no") <= head) & ((F.col("from_top") <= 0.45 * budget) | (F.col("line_no") == 1))
    in_tail = ~in_head & (place <= tail) & ((F.col("from_end") <= 0.25 * budget) | (place == 1))
    own = own.withColumn("part", F.when(in_head, "head").when(in_tail, "tail").when(T.is_salient(F.col("line")), "salient").otherwise("hidden"))
    by_part = Window.partitionBy("id", "part").orderBy("line_no")
    own = own.withColumns({"part_no": F.row_number().over(by_part), "part_cost": F.sum("cost").over(by_part.rowsBetween(*far))})
    kept = (F.col("part") != "hidden") & ((F.col("part") != "salient") | ((F.col("part_no") <= SALIENT_MAX) & (F.col("part_cost") <= 0.30 * budget)))
    return own.where(kept).select("id", "line_no", "part", T.cut_line(F.col("line")).alias("line"))


def grep(lines: DataFrame, needles: list[str], context: int) -> DataFrame:
    """Lines with one of the needles (any case), and ``context`` lines around them."""
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(F.lower("line"), F.lit(n.lower()))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(-context, context)
    return lines.withColumn("hit", hit).withColumn("near", F.max("hit").over(w)).where("near").select("id", "line_no", "hit", "line")


def unfold(lines: DataFrame, first: int, last: int) -> DataFrame:
    """A range of lines; reversed bounds are swapped."""
    a, b = min(first, last), max(first, last)
    return lines.where(F.col("line_no").between(a, b)).select("id", "line_no", "line")


def rebuild(lines: DataFrame) -> DataFrame:
    """The body, from its lines."""
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))


def span_text(turns: DataFrame, low: Column, high: Column) -> DataFrame:
    """The turns of each session in a range, joined."""
    return turns.where(F.col("turn").between(low, high)).groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("body"))


def stub(fold_id: Column, text: Column) -> Column:
    """F19."""
    return F.concat(F.lit("F"), fold_id.cast("string"), F.lit(": "), F.size(T.lines(text)).cast("string"), F.lit(" lines, "), F.bround(F.octet_length(text) / 1024, 0).cast("long").cast("string"), F.lit(" KB"))


def eligible(events: DataFrame, threshold: int = 12000, least: int = 1000) -> Column:
    """Outputs long enough to fold."""
    return F.length("output") > max(threshold, least)
