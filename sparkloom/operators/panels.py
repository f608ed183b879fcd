"""Small reports over sessions, folds, the graph and error logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import live

# The window in which a session counts as the present one, and how many sessions a panel lists.
SESSION_HOURS, PANEL = 12, 8
CODE_KINDS = ["function", "method", "class"]


def fold_stats(folds: DataFrame) -> DataFrame:
    """(kind, n, chars): the folds of each kind; chars is the length of the bodies, for tools only."""
    return folds.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "tool", F.length("body"))), F.lit(0)).cast("long").alias("chars"))


def session_panel(sessions: DataFrame, items: DataFrame, limit: int = PANEL) -> DataFrame:
    """The sessions last seen, each with its records and whether a handoff was written; ties go to the smaller id.

    sessions: session_id, last_seen_at and more; items: session_id, kind, source. Only
    the records of the listed sessions are counted.
    """
    few = sessions.orderBy(F.desc("last_seen_at"), "session_id").limit(limit)
    own = items.join(few.select("session_id"), "session_id", "left_semi")
    counts = own.groupBy("session_id").agg(F.count_if(F.col("kind") != "handoff").alias("items"), F.coalesce(F.bool_or((F.col("kind") == "handoff") & (F.col("source") != "auto")), F.lit(False)).alias("handoff"))
    return few.join(counts, "session_id", "left").withColumns({"items": F.coalesce("items", F.lit(0)), "handoff": F.coalesce("handoff", F.lit(False))})


def newest_session(sessions: DataFrame, now: Column, by: list[str] = (), hours: int = SESSION_HOURS) -> DataFrame:
    """Of each group (``by``; none: of all) the session last seen, if within ``hours`` before ``now``; ties go to the greater id."""
    recent = sessions.where(F.col("last_seen_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy(*by).agg(F.max_by("session_id", F.struct("last_seen_at", "session_id")).alias("session_id")).where("session_id is not null")


def graph_counts(files: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame, folds: DataFrame) -> DataFrame:
    """One row: files, symbols, open edges, records that hold and folds."""
    each = {
        "files": files,
        "symbols": nodes.where(F.col("deleted_at").isNull() & F.col("kind").isin(CODE_KINDS)),
        "edges": edges.where(F.col("valid_to").isNull()),
        "items": items.where((F.col("kind") != "handoff") & live()),
        "folds": folds,
    }
    rows = None
    for name, df in each.items():
        one = df.agg(F.count("*").alias(name))
        rows = one if rows is None else rows.crossJoin(F.broadcast(one))  # one row each
    return rows


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """(at, event, last): the entries of error logs, each after a line of three dashes, with their last line that is not blank; a bad moment is null."""
    raw = spark.read.text(path, lineSep="--- ").select(F.col("value").alias("entry")).where(F.trim("entry") != "")
    head = F.split(F.element_at(F.split(F.trim("entry"), "\n"), 1), " ")
    lines = F.filter(F.transform(F.split("entry", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(F.try_to_timestamp(F.get(head, 0), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), F.get(head, 1).alias("event"), F.get(lines, F.size(lines) - 1).alias("last"))


def log_errors(entries: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row (n, last): the entries within ``hours`` before ``now``, and the last line of the latest."""
    recent = entries.where(F.col("at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    return recent.agg(F.count("*").alias("n"), F.max_by("last", F.struct("at", "last")).alias("last"))


def present_handoff(items: DataFrame, by: str = "source_project") -> DataFrame:
    """Of each project's active handoffs the newest written one; an automatic one only where none was written."""
    rows = items.where("kind = 'handoff' and status = 'active'")
    best = F.max_by(F.struct("*"), F.struct(F.col("source") != "auto", "created_at", "id"))
    return rows.groupBy(by).agg(best.alias("_h")).select("_h.*")
