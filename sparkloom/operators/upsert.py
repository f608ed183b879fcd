"""Keyed changes of tables as joins: new tables come back, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import postings

KEPT_SCANS = 400


def opened(touches: DataFrame) -> DataFrame:
    """One row per session from touches (session_id, ts, agent, cwd, title, prompt): of each text the last that is not null."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in ("agent", "cwd", "title")}
    rows = touches.groupBy("session_id").agg(*last.values(), F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count_if("prompt").alias("prompts"))
    return rows.withColumns({"ended_at": F.lit(None).cast(rows.schema["last_seen_at"].dataType), "end_reason": F.lit(None).cast("string")})


def touch_sessions(sessions: DataFrame, touches: DataFrame) -> DataFrame:
    """K8: sessions after some touches, which may come late or out of order.

    The earliest start and the latest touch count; texts of the later side win; a
    session that had ended is open again if it was touched after its end.
    """
    a, b = sessions.alias("a"), opened(touches).withColumn("_new", F.lit(True)).alias("b")
    new = F.coalesce("b._new", F.lit(False))
    later = F.coalesce(F.col("b.last_seen_at") >= F.col("a.last_seen_at"), new)

    def own(name: str) -> Column:
        return F.when(later, F.coalesce(f"b.{name}", f"a.{name}")).otherwise(F.coalesce(f"a.{name}", f"b.{name}")).alias(name)

    again = new & (F.col("a.ended_at").isNull() | (F.col("b.last_seen_at") >= F.col("a.ended_at")))
    return a.join(b, "session_id", "full_outer").select(
        "session_id", own("agent"), own("cwd"), own("title"), F.least("a.started_at", "b.started_at").alias("started_at"), F.greatest("a.last_seen_at", "b.last_seen_at").alias("last_seen_at"),
        (F.coalesce("a.prompts", F.lit(0)) + F.coalesce("b.prompts", F.lit(0))).alias("prompts"),
        *[F.when(~again, F.col(f"a.{c}")).alias(c) for c in ("ended_at", "end_reason")],
    )


def add_sessions(sessions: DataFrame, more: DataFrame) -> DataFrame:
    """K9: sessions whose id is not there yet are added, the others left as they are; of several with one id the earliest started."""
    first = more.groupBy("session_id").agg(F.min_by(F.struct("*"), F.struct("started_at", F.struct(*[c for c in more.columns if c != "session_id"]))).alias("_s")).select("_s.*")
    return sessions.unionByName(first.join(sessions.select("session_id"), "session_id", "left_anti"), allowMissingColumns=True)


def end_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """K9: ends (session_id, at, reason) applied, of several the last; an end before the last touch does nothing."""
    e = ends.groupBy("session_id").agg(F.max("at").alias("_at"), F.max_by("reason", F.struct("at", "reason")).alias("_reason"))
    gone = F.coalesce(F.col("_at") >= F.col("last_seen_at"), F.lit(False))
    set_ = {"ended_at": F.when(gone, F.col("_at")).otherwise(F.col("ended_at")), "end_reason": F.when(gone, F.col("_reason")).otherwise(F.col("end_reason")), "last_seen_at": F.when(gone, F.col("_at")).otherwise(F.col("last_seen_at"))}
    return sessions.join(e, "session_id", "left").withColumns(set_).drop("_at", "_reason")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), fixed: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key; a null in a ``keep`` column keeps the old value, a ``fixed`` column stays as first written.

    Of several new rows with a key the greatest counts (``latest`` chooses otherwise); null keys are one key.
    """
    rest = [c for c in old.columns if c != key]
    new = new.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])

    def pick(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
        first, then = ("a", "b") if c in fixed else ("b", "a")
        return F.when(F.col(f"{first}._in").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{then}.{c}"))

    a, b = (df.withColumn("_in", F.lit(True)).alias(n) for df, n in ((old, "a"), (new.select(*old.columns), "b")))
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    return joined.select(*[F.coalesce(f"a.{key}", f"b.{key}").alias(key) if c == key else pick(c).alias(c) for c in old.columns])


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Of each key the row that is greatest by ``order``, without sorting a group."""
    return rows.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def soft_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``ids`` (id) marked, and their open edges closed; what was marked or closed before keeps its time."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    kept = nodes.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("_gone")
    src, dst = (gone.select(F.col("id").alias(c), F.col("_gone").alias(f"_{c}")) for c in ("src", "dst"))
    hit = F.col("valid_to").isNull() & (F.col("_src").isNotNull() | F.col("_dst").isNotNull())
    closed = edges.join(src, "src", "left").join(dst, "dst", "left").withColumn("valid_to", F.when(hit, now).otherwise(F.col("valid_to")))
    return kept, closed.select(*edges.columns)


def put_postings(index: DataFrame, changed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """An index (id, term, tf, dl) in which the given documents stand anew; only they are split into words."""
    ids = changed.select(F.col(id_col).alias("id")).distinct()
    return index.join(ids, "id", "left_anti").unionByName(postings(changed, id_col, text_col).select(*index.columns))


def keep_history(scans: DataFrame, changes: DataFrame, kept: int = KEPT_SCANS) -> tuple[DataFrame, DataFrame]:
    """Older scans (id, changed) without a change go, and the changes (scan_id, ...) whose scan is gone."""
    last = scans.agg(F.max("id").alias("_last"))
    stay = scans.crossJoin(F.broadcast(last)).where((F.col("id") > F.col("_last") - kept) | F.col("changed")).drop("_last")  # one row
    return stay, changes.join(stay.select(F.col("id").alias("scan_id")), "scan_id", "left_semi")
