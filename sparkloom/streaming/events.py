"""Event handlers as Structured Streaming and as batch replay.

Sessions are keyed state: prompts, the last prompt and the end.  ``replay`` over
an event table gives what the stream gives after the same events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What an event type stands for.
NAMES = {"signup": "session-start", "view": "prompt", "click": "edit", "purchase": "stop", "error": "large-output"}


def named(events: DataFrame) -> DataFrame:
    """T17."""
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return events.withColumn("event", F.coalesce(table[F.col("event_type")], F.lit("unknown")))


def session_state(events: DataFrame) -> DataFrame:
    """One row per session; aggregates only, so it is the same for a stream (update mode) and a table."""
    return named(events).groupBy(F.col("user_id").alias("session_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count_if(F.col("event") == "prompt").alias("prompts"), F.count_if(F.col("event") == "edit").alias("edits"), F.count_if(F.col("event") == "large-output").alias("folds"), F.count("*").alias("events")
    )


def replies(events: DataFrame) -> DataFrame:
    """Each stop event with the prompt it answers: the last one before it in its session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    prompt = F.last(F.when(F.col("event") == "prompt", F.col("event_id")), True).over(w)
    return named(events).withColumn("prompt_id", prompt).where("event = 'stop'").select("event_id", F.col("user_id").alias("session_id"), "prompt_id")


def changes(events: DataFrame, since) -> DataFrame:
    """Sessions touched since a moment, with two seconds' grace."""
    return events.where(F.col("ts") >= since - F.expr("interval 2 seconds")).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("changed_at"), F.count("*").alias("events"))


def stream(events: DataFrame, sink, checkpoint: str):
    """Start the session stream over a streaming ``events``; ``sink(df, batch_id)`` gets every changed session."""
    return session_state(events.withWatermark("ts", "1 day")).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def dead_letters(raw: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rows that are no events)."""
    parsed = raw.withColumn("_e", F.from_json(column, schema))
    bad = F.col("_e").isNull() | F.forall(F.array(*[F.col(f"_e.{f.split()[0]}").cast("string") for f in schema.split(",")]), lambda x: x.isNull())
    return parsed.where(~bad).select("_e.*"), parsed.where(bad).select(column)
