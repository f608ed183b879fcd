"""Records, sessions and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What closing a record of a kind makes of it.
CLOSE = {("task", "done"): "done", ("error", "done"): "fixed", ("task", "drop"): "dropped", ("error", "drop"): "dropped", ("pin", "drop"): "retired", ("note", "drop"): "retired", ("decision", "drop"): "retracted", ("handoff", "drop"): "superseded"}
FORGET = {"pin": "retired", "decision": "retracted", "task": "dropped", "error": "dropped", "note": "retired", "handoff": "superseded"}


def close(items: DataFrame, requests: DataFrame, live: Column) -> DataFrame:
    """K3: requests (id, verb) applied; ``error`` says why one was not."""
    table = F.create_map(*[F.lit(x) for (k, v), s in CLOSE.items() for x in (f"{k} {v}", s)])
    new = table[F.concat_ws(" ", "kind", "verb")]
    joined = requests.join(items.withColumn("_live", live), "id", "left")
    error = F.when(F.col("kind").isNull(), "unknown id").when(~F.col("_live"), "already closed").when(new.isNull(), "not possible for this kind")
    return joined.select("id", "kind", "verb", F.when(error.isNull(), new).otherwise(F.col("status")).alias("status"), error.alias("error"))


def forget(items: DataFrame, ids: DataFrame) -> DataFrame:
    """K4: texts of the given ids are blanked; a closed status stays."""
    table = F.create_map(*[F.lit(x) for k, s in FORGET.items() for x in (k, s)])
    from ..sources.tables import live

    return items.join(ids.select("id", F.lit(True).alias("_gone")), "id", "left").withColumns({"text": F.when(F.col("_gone"), "[forgotten]").otherwise(F.col("text")), "status": F.when(F.col("_gone") & live(), table[F.col("kind")]).otherwise(F.col("status"))}).drop("_gone")


def matrix(items: DataFrame, live: Column) -> DataFrame:
    """A2: live, superseded and closed records by kind."""
    return items.groupBy("kind").agg(F.count_if(live).alias("live"), F.count_if(~live & (F.col("status") == "superseded")).alias("superseded"), F.count_if(~live & (F.col("status") != "superseded")).alias("closed"))


def calendar(events: DataFrame, ts: str, kind: str, days: int, last: Column) -> DataFrame:
    """A3: counts by day and kind over ``days`` days up to ``last``, zeros included."""
    day = F.to_date(ts)
    counted = events.where(day > F.date_sub(last, days)).groupBy(day.alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    spine = events.select(F.col(kind).alias("kind")).distinct().withColumn("day", F.explode(F.sequence(F.date_sub(last, days - 1), last)))
    return spine.join(counted, ["day", "kind"], "left").select("day", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sessions(turns: DataFrame) -> DataFrame:
    """K8: one row per session."""
    return turns.groupBy("session_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("last_seen_at"), F.count_if(F.col("role") == "user").alias("prompts"), F.count("*").alias("turns"))


def silent(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions without a user's turn."""
    return sessions.join(turns.where(F.col("role") == "user").select("session_id"), "session_id", "left_anti")


def dedupe_turns(turns: DataFrame, order: list[str]) -> DataFrame:
    """The first of turns equal in session, role, prompt and hash; blank ones go."""
    w = Window.partitionBy("session_id", "role", F.coalesce(F.col("prompt_id").cast("string"), F.lit("")), "hash").orderBy(*order)
    return turns.where(F.trim("text") != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def supersession(items: DataFrame) -> DataFrame:
    """Each record with what replaced it and what it replaces."""
    a, b = items.alias("a"), items.select(F.col("id").alias("by_id"), F.col("kind").alias("by_kind"), F.col("status").alias("by_status")).alias("b")
    replaces = items.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("r")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("replaces"))
    return a.join(b, F.col("a.superseded_by") == F.col("by_id"), "left").join(replaces, F.col("a.id") == F.col("r"), "left").select("a.id", "a.kind", "a.status", "superseded_by", "by_status", F.coalesce("replaces", F.lit("")).alias("replaces"))


def latest_handoff(items: DataFrame) -> DataFrame:
    """By source of writing, the newest active handoff."""
    return items.where("kind = 'handoff' and status = 'active'").groupBy("source").agg(F.max(F.struct("created_at", "id")).alias("m")).select("source", F.col("m.id").alias("id"), F.col("m.created_at").alias("created_at"))


def neighbours(turns: DataFrame, ids: DataFrame, around: int) -> DataFrame:
    """Turns within ``around`` places of the given ones in their session."""
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("id")))
    centre = placed.join(ids, "id").select(F.col("id").alias("centre"), "session_id", F.col("place").alias("at"))
    return centre.join(placed, "session_id").where(F.abs(F.col("place") - F.col("at")) <= around).select("centre", "id", (F.col("place") - F.col("at")).cast("long").alias("distance"))


def prune(rows: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """What is not older than the cut-off."""
    return rows.where(F.col(ts) >= cutoff)
