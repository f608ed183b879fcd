"""Records of an older store: mapping, merging and importing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Statuses of older tasks, words of a solved error, reasons of automatic checkpoints.
DONE = ["done", "complete", "completed", "finished", "shipped", "resolved", "closed", "fixed", "merged"]
DROPPED = ["dropped", "cancelled", "canceled", "abandoned", "wontfix", "obsolete"]
FIXED = r"(?i)\b(fixed|resolved|solved|done|completed)\b"
GENERIC = ["", "sessionend", "sessionstop", "precompact", "postcompact", "compact", "autocompact", "stop", "checkpoint"]
ROLES = ["user", "assistant", "system"]
#: Older tables in the order in which records of one time are imported.
TABLES = ["pins", "decisions", "tasks", "errors", "checkpoints"]


def task_status(status: Column, text: Column) -> Column:
    """P16."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin(DROPPED), "dropped").when(s.isin(DONE) | T.looks_done(text), "done").otherwise("open")


def is_generic(reason: Column) -> Column:
    """A checkpoint that says nothing but why it was made."""
    return F.regexp_replace(F.lower(F.coalesce(reason, F.lit(""))), r"[\s_\-]+", "").isin(GENERIC)


def role(value: Column) -> Column:
    return F.when(value.isin(ROLES), value).otherwise("system")


def records(old: dict[str, DataFrame], origin: str | None = None) -> DataFrame:
    """M6: (kind, status, text, origin, created_at, session_id, ord, row) of the older tables that are given.

    Every table has row, created_at and session_id; pins, decisions (accepted,
    rejected) and tasks (status) have text, errors have text and context,
    checkpoints have text. Blank texts and generic checkpoints go.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    kinds = {
        "pins": (F.when(T.is_snapshot(text), "note").otherwise("pin"), F.lit("active"), text),
        "tasks": (F.lit("task"), None, text),
        "checkpoints": (F.lit("handoff"), F.lit("active"), text),
    }
    out = []
    for n, name in enumerate(TABLES):
        if name not in old:
            continue
        df = old[name]
        if name == "decisions":
            flag = F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(F.coalesce("accepted", F.lit(False)), "accepted")
            kind, status, body = F.when(flag.isNull(), "note").otherwise("decision"), F.coalesce(flag, F.lit("active")), text
        elif name == "errors":
            context = F.trim(F.coalesce("context", F.lit("")))
            body = F.when(context != "", F.concat(text, F.lit("\n"), context)).otherwise(text)
            kind, status = F.lit("error"), F.when(body.rlike(FIXED), "fixed").otherwise("open")
        else:
            kind, status, body = kinds[name]
        if name == "tasks":
            status = task_status(F.col("status"), text)
        if name == "checkpoints":
            df = df.where(~is_generic(F.col("text")))
        out.append(df.select(kind.alias("kind"), status.alias("status"), body.alias("text"), F.lit(origin).cast("string").alias("origin"), "created_at", "session_id", F.lit(n).alias("ord"), "row").where("text <> ''"))
    return reduce(DataFrame.unionByName, out)


def merge(root: DataFrame, nested: DataFrame) -> DataFrame:
    """M7: all records of the root's store, and of nested ones the first of each kind and text that the root lacks; handoffs all stay."""
    key = T.key_of(F.col("kind"), F.col("text"))
    seen = root.select(F.xxhash64(key).alias("_h"), key.alias("_key")).distinct()
    keyed = nested.withColumns({"_key": key, "_h": F.xxhash64(key)})
    first = keyed.where("kind <> 'handoff'").join(seen, ["_h", "_key"], "left_anti")
    first = first.groupBy("_key").agg(F.min(F.struct("created_at", "ord", "origin", "row", *[c for c in nested.columns if c not in ("created_at", "ord", "origin", "row")])).alias("_r")).select("_r.*")
    return root.unionByName(first).unionByName(nested.where("kind = 'handoff'"))


def tally(merged: DataFrame) -> DataFrame:
    """A16."""
    return merged.groupBy("kind", "status").agg(F.count("*").alias("n"))


def chain(merged: DataFrame, by: str | None = None) -> DataFrame:
    """M8: of the handoffs (of each ``by``) the newest stays active, each older one is superseded by the next."""
    own = [by] if by else []
    hand = merged.where("kind = 'handoff'")
    nxt = F.lead("row").over(Window.partitionBy(*own).orderBy("created_at", "ord", "row"))
    linked = hand.withColumn("superseded_by", nxt).withColumn("status", F.when(F.col("superseded_by").isNull(), "active").otherwise("superseded"))
    return merged.where("kind <> 'handoff'").withColumn("superseded_by", F.lit(None).cast(merged.schema["row"].dataType)).unionByName(linked.select(*merged.columns, "superseded_by"))


def apply_routes(routes: DataFrame, existing: DataFrame) -> DataFrame:
    """Routes (id, project, accept, kind, text) that are imported; a second run imports nothing.

    ``outcome`` is skipped (not accepted or without a project), duplicate (the
    project has a record of that kind and text, or an earlier route brings it) or
    imported.
    """
    key = T.key_of(F.col("kind"), F.col("text"))
    have = existing.select("project", key.alias("_key")).distinct().withColumn("_have", F.lit(True))
    valid = F.coalesce("accept", F.lit(False)) & F.col("project").isNotNull()
    marked = routes.withColumns({"_key": key, "_valid": valid})
    first = marked.where("_valid").groupBy("project", "_key").agg(F.min("id").alias("_first"))
    joined = marked.join(first, ["project", "_key"], "left").join(have, ["project", "_key"], "left")
    outcome = F.when(~F.col("_valid"), "skipped").when(F.col("_have") | (F.col("id") != F.col("_first")), "duplicate").otherwise("imported")
    return joined.select("id", "project", "kind", outcome.alias("outcome"))


def is_store(path: Column, name: str) -> Column:
    """A store below a project's root: its file stands in the folder of that name, in no dependency folder."""
    inside = F.arrays_overlap(F.split(path, "/"), F.array(F.lit("node_modules"), F.lit(".git"), F.lit("__pycache__")))
    return path.rlike(rf"(^|/)\.{name}/[^/]+\.db$") & ~inside


def old_table(spark, url: str, table: str) -> DataFrame:
    """A table of an older store over JDBC, read only; a driver for the URL must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, sessionInitStatement="PRAGMA query_only = 1").load()
