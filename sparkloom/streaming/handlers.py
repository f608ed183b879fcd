"""What single events say, and batch forms of what a session leaves (P13, P14, T4, T8, M13); the state of sessions is in ``sessions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that may stand before a switching phrase, and the phrases around the tool's name.
FILLER = ["ok", "okay", "please", "pls", "now", "hey", "so", "and", "alright", "right", "yes", "yeah"]
OFF = ["stop using {0}", "disable {0}", "{0} off", "stop {0}", "turn off {0}", "turn {0} off"]
ON = ["enable {0}", "use {0}", "{0} on", "turn on {0}", "turn {0} on", "start using {0}"]

# Files that a session keeps, and files and records that a handoff lists.
FILES_KEPT, FILES_LISTED, RECORDS_LISTED = 100, 8, 12


def from_harness(text: Column, prefixes: list[str]) -> Column:
    """Whether a prompt was written by the surrounding program, by how it begins."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.regexp_replace(text, r"^\s+", ""), p))


def toggle(text: Column, name: str, off: list[str] = OFF, on: list[str] = ON) -> Column:
    """P14: 'off' or 'on' if a prompt begins, after filler words, with a switching phrase; else null."""
    said = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), " ")
    said = F.concat(F.regexp_replace(said, f"^(({'|'.join(FILLER)})( |$))+", ""), F.lit(" "))

    def any_of(begun: Column, phrases: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(p.format(name) + " ") for p in phrases]), lambda p: F.startswith(begun, p))

    return T.let(said, lambda begun: F.when(any_of(begun, off), "off").when(any_of(begun, on), "on"))


def touched(edits: DataFrame, most: int = FILES_KEPT) -> DataFrame:
    """T4: (session_id, path, at, place): of the files of a session, in the order of first touch, the last ``most``; place 1 is the oldest of these."""
    first = edits.groupBy("session_id", "path").agg(F.min("ts").alias("at"))
    own = Window.partitionBy("session_id")
    late = first.withColumn("_k", F.row_number().over(own.orderBy(F.desc("at"), F.desc("path")))).where(F.col("_k") <= most).drop("_k")
    return late.withColumn("place", F.row_number().over(own.orderBy("at", "path")).cast("long"))


def auto_handoff(ends: DataFrame, prompts: DataFrame, files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(session_id, text) for each ended session with prompts and no handoff of its own.

    ends (session_id, reason), prompts (session_id, id, text), files as by
    ``touched``, recorded (session_id, id, kind, label).
    """
    said = prompts.groupBy("session_id").agg(F.count("*").alias("n"), F.max_by("text", "id").alias("last"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= FILES_LISTED, F.struct("place", "path")))), lambda x: x["path"])
    seen = files.groupBy("session_id").agg(F.count("*").alias("n_files"), F.array_join(names, ", ").alias("files"))
    rest = recorded.where("kind <> 'handoff'").withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).where(F.col("_k") <= RECORDS_LISTED)
    own = rest.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    written = recorded.where("kind = 'handoff'").select("session_id")
    more = F.when(F.col("n_files") > FILES_LISTED, F.concat(F.lit(" (+"), F.col("n_files") - FILES_LISTED, F.lit(" more)."))).otherwise(".")
    text = F.concat_ws(  # fixed output: the sentences of an automatic handoff
        " ",
        F.concat(F.lit("Auto-handoff (session ended: "), F.coalesce("reason", F.lit("unknown")), F.lit("; no handoff was written). "), F.col("n"), F.lit(' prompt(s). Last request: "'), T.truncate(F.col("last"), 200), F.lit('".')),
        F.concat(F.lit("Files edited: "), F.col("files"), more),
        F.concat(F.lit("Recorded: "), F.col("labels"), F.lit(".")),
    )
    due = ends.join(written, "session_id", "left_anti").join(said, "session_id").join(seen, "session_id", "left").join(own, "session_id", "left")
    return due.select("session_id", text.alias("text"))
