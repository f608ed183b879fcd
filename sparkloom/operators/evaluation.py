"""Quality of retrieval and folding over cases read from JSON, with gates.

A case file has items (key, kind, text, and where given status, why, critical),
supersede (old, new), recall (query, expect), stale (query, must_not), abstain
(queries), guard (prompt, expect), fold (lines, salient: text by line number) and
thresholds. All cases of a kind are one query table and run as one search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import live
from . import folding, index, retrieval, toolfolds

CASE = (
    "items array<struct<key:string,kind:string,status:string,text:string,why:string,critical:boolean>>, supersede array<struct<old:string,new:string>>, recall array<struct<query:string,expect:string>>, "
    "stale array<struct<query:string,must_not:string>>, abstain array<string>, guard array<struct<prompt:string,expect:string>>, fold struct<lines:int,salient:map<string,string>>, thresholds map<string,string>"
)
# What a new record of a kind is, and which way a gate is open.
FIRST_STATUS = {"decision": "accepted", "pin": "active", "task": "open", "error": "open", "note": "active", "handoff": "active"}
AT_MOST = ["stale_errors", "fold_ratio"]
RECALL_AT, FOUND = 3, 12


# -------------------------------------------------------------------- metrics
def recall_at(hits: DataFrame, expected: DataFrame, k: int = RECALL_AT) -> DataFrame:
    """One row (value): the share of the queries of ``expected`` (query_id, id) that have one of their ids among the first ``k`` of ``hits`` (query_id, id, rank)."""
    found = hits.where(F.col("rank") <= k).join(expected, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(1.0))
    return expected.select("query_id").distinct().join(found, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)).alias("value"))


def reciprocal_rank(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (value): the mean over queries of 1 / the best rank of an expected id, 0 where none is found."""
    best = hits.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg((1.0 / F.min("rank")).alias("_r"))
    return expected.select("query_id").distinct().join(best, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("_r", F.lit(0.0))), F.lit(0.0)).alias("value"))


def best_place(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, id, rank) of each query with ``hits`` (query_id, id, score): its first expected id by score, then id, and how far down it is; null where none is found.

    What stands before it is counted, so no task sorts the hits of a query.
    """
    place = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))
    best = hits.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min(place).alias("_best"))
    found = hits.join(F.broadcast(best), "query_id", "left")  # a row a query
    return found.groupBy("query_id", F.col("_best.id").alias("id")).agg(F.when(F.max(F.col("_best").isNotNull()), F.count_if(place < F.col("_best")) + 1).alias("rank"))


def gain_at(hits: DataFrame, graded: DataFrame, k: int = 10) -> DataFrame:
    """One row (value): the mean normalised discounted gain of the first ``k`` hits, for ``graded`` (query_id, id, grade)."""
    discount = F.log2(F.col("rank") + 1.0)
    got = hits.where(F.col("rank") <= k).join(graded, ["query_id", "id"]).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / discount).alias("_got"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = graded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / discount).alias("_best"))
    return ideal.join(got, "query_id", "left").where("_best > 0").agg(F.coalesce(F.avg(F.coalesce("_got", F.lit(0.0)) / F.col("_best")), F.lit(0.0)).alias("value"))


def forbidden(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row (value): how many of ``pairs`` (query_id, id) are hits though they must not be."""
    return hits.join(pairs, ["query_id", "id"], "left_semi").select("query_id", "id").distinct().agg(F.count("*").cast("double").alias("value"))


def abstained(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """One row (value): the share of the queries (query_id) without a hit; 0 without queries."""
    some = hits.select("query_id").distinct().withColumn("_some", F.lit(0.0))
    return asked.select("query_id").distinct().join(some, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("_some", F.lit(1.0))), F.lit(0.0)).alias("value"))


# ------------------------------------------------------------------------ run
@dataclass(frozen=True)
class Cases:
    items: DataFrame
    recall: DataFrame
    stale: DataFrame
    abstain: DataFrame
    guard: DataFrame
    fold: DataFrame
    thresholds: DataFrame


def read_cases(spark: SparkSession, path: str) -> Cases:
    """The case file as tables; items get their numbers in the order of the file, and what another supersedes is marked."""
    raw = spark.read.schema(CASE).json(path, multiLine=True)

    def part(name: str, *columns: str) -> DataFrame:
        return raw.select(F.posexplode(name).alias("query_id", "c")).select((F.col("query_id") + 1).cast("long").alias("query_id"), *[f"c.{c}" for c in columns])

    first = F.create_map(*[F.lit(x) for kv in FIRST_STATUS.items() for x in kv])
    items = part("items", "key", "kind", "status", "text", "why", "critical").withColumnRenamed("query_id", "id")
    gone = raw.select(F.explode("supersede").alias("s")).select(F.col("s.old").alias("key"), F.lit(True).alias("_gone"))
    status = F.when(F.col("_gone"), "superseded").otherwise(F.coalesce("status", first[F.col("kind")]))
    items = items.join(gone, "key", "left").select("id", "key", "kind", status.alias("status"), "text", "why", F.coalesce("critical", F.lit(False)).alias("priority"))
    ids = items.select("id", "key")

    def known(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids.withColumnRenamed("key", column), column).drop(column)

    abstain = raw.select(F.posexplode("abstain").alias("k", "query")).select((F.col("k") + 1).cast("long").alias("query_id"), "query")
    guard = part("guard", "prompt", "expect").withColumnRenamed("prompt", "query")
    return Cases(items, known(part("recall", "query", "expect"), "expect"), known(part("stale", "query", "must_not"), "must_not"), abstain, known(guard, "expect"), raw.select("fold.*"), raw.select(F.explode("thresholds").alias("name", "gate")))


def searched(items: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rank) over the records that hold, by the words that mean something."""
    body = T.search_text(T.derive_title(F.col("text")), F.col("text"), F.coalesce("why", F.lit("")))
    built = index.build(items.where(live()).select("id", body.alias("text")), "id", "text")
    words = asked.select("query_id", F.array_join(T.query_words(F.col("query")), " ").alias("query"))
    return index.search(built, words, limit).select("query_id", "id", "rank")


def folded_log(fold: DataFrame, line: Column) -> DataFrame:
    """(text, salient): a log of ``lines`` lines (``line`` of its number ``i``) with the salient ones in their places."""
    numbers = F.sequence(F.lit(1), F.col("lines"))
    return fold.select(F.array_join(F.transform(numbers, lambda i: F.coalesce(F.col("salient")[i.cast("string")], F.concat(F.lit("["), F.lpad(i.cast("string"), 5, "0"), F.lit("] "), line))), "\n").alias("text"), F.map_values("salient").alias("salient"))


def run(cases: Cases) -> DataFrame:
    """(metric, value, gate, passed): every metric of the cases with its gate, where there is one."""
    hits = searched(cases.items, cases.recall, FOUND)
    prompts = cases.guard.select("query_id", F.col("query_id").cast("string").alias("session_id"), F.lit(0).alias("ts"), "query")
    guarded = cases.items.withColumn("text", F.concat_ws(" ", T.derive_title(F.col("text")), "text"))
    warned = retrieval.guard(guarded, prompts).select("query_id", "id", F.lit(1).alias("rank"))
    log = folded_log(cases.fold, F.lit("step of a long log that says nothing new"))
    shown = log.select("text", "salient", F.concat(toolfolds.view(F.col("text")), F.lit("\n"), folding.stub(F.lit(1).cast("long"), F.col("text"))).alias("view"))
    kept = shown.select("view", F.explode("salient").alias("s")).agg(F.avg(F.when(F.contains(F.col("view"), F.col("s")), 1.0).otherwise(0.0)).alias("value"))
    lines = folding.numbered(log.select(F.lit(1).alias("id"), "text"), "id", "text")
    exact = folding.rebuild(lines).join(log.select(F.lit(1).alias("id"), "text"), "id").agg(F.avg(F.when(F.col("body") == F.col("text"), 1.0).otherwise(0.0)).alias("value"))
    each = {
        "recall_at_3": recall_at(hits, cases.recall.select("query_id", "id")),
        "mean_reciprocal_rank": reciprocal_rank(hits, cases.recall.select("query_id", "id")),
        "stale_errors": forbidden(searched(cases.items, cases.stale, FOUND), cases.stale.select("query_id", "id")),
        "abstain_rate": abstained(searched(cases.items, cases.abstain, FOUND), cases.abstain),
        "guard_rate": recall_at(warned, cases.guard.select("query_id", "id"), 1),
        "salient_kept": kept,
        "fold_ratio": shown.select((F.length("view") / F.length("text")).alias("value")),
        "unfold_exact": exact,
    }
    rows = None
    for name, value in each.items():
        one = value.select(F.lit(name).alias("metric"), F.round("value", 4).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    gates = cases.thresholds.select(F.regexp_replace("name", "_max$", "").alias("metric"), F.when(F.lower("gate") == "true", 1.0).otherwise(F.col("gate").try_cast("double")).alias("gate"))
    passed = F.when(F.col("metric").isin(AT_MOST), F.col("value") <= F.col("gate")).otherwise(F.col("value") >= F.col("gate"))
    return rows.join(gates, "metric", "left").select("metric", "value", "gate", passed.alias("passed"))
