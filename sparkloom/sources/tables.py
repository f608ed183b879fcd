"""Logical tables of the library over the driver's Parquet files, and file and log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
# Kinds of records, their statuses, and those that still hold.
KINDS = ["pin", "decision", "task", "error", "note", "handoff"]
STATUSES = {
    "pin": ["active", "retired", "superseded"],
    "decision": ["accepted", "rejected", "superseded", "retracted"],
    "task": ["open", "done", "dropped", "superseded"],
    "error": ["open", "fixed", "dropped", "superseded"],
    "note": ["active", "retired", "superseded"],
    "handoff": ["active", "superseded"],
}
LIVE = {"pin": ["active"], "decision": ["accepted", "rejected"], "task": ["open"], "error": ["open"], "note": ["active"], "handoff": ["active"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(minutes: Column) -> Column:
    return (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))).cast("timestamp_ntz")


def items(docs: DataFrame) -> DataFrame:
    """Records with a kind, a status and a supersession link, from documents."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    allowed = F.create_map(*[x for k, v in STATUSES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = docs.select("doc_id", "text", "source", kind.alias("kind"))
    own = allowed[F.col("kind")]
    status = F.element_at(own, (F.floor(F.col("doc_id") / 6) % 4 % F.size(own) + 1).cast("int"))
    return out.withColumn("status", status).withColumns({"priority": F.col("doc_id") % 12 == 0, "superseded_by": F.when(F.col("status") == "superseded", F.col("doc_id") + 6), "created_at": at(F.col("doc_id"))})


def live(kind: str = "kind", status: str = "status") -> Column:
    """P1."""
    out = F.lit(False)
    for k, v in LIVE.items():
        out = out | ((F.col(kind) == k) & F.col(status).isin(v))
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """Messages with a session, a hash and the prompt they answer; ids follow (conv_id, turn) without a global sort."""
    prompts = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "conv_id", "turn", "role", "text", F.sha1("text").alias("hash"), prompts.alias("prompt_id"), at(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"))


def commits(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits, and the files each touched with lines added and deleted."""
    files = lineitem.groupBy(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path")).agg(F.sum("l_quantity").cast("long").alias("added"), F.sum("l_linenumber").cast("long").alias("deleted"))
    return orders.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts")), files


def pages_files(pages: DataFrame) -> DataFrame:
    """(page_id, path): the URL's path without query and fragment."""
    return pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "").alias("path"))


def imports(pages: DataFrame) -> DataFrame:
    """(page_id, href): every link of every page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def code_files(spark: SparkSession, root: str, max_bytes: int = 1_500_000, skip_dirs: tuple[str, ...] = ("node_modules", "build", "dist", ".git", "__pycache__")) -> DataFrame:
    """Text files below a folder: regular, of bounded size, not binary, in no skipped folder."""
    from ..functions import paths

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    inside = F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, skip_dirs)))
    ok = (F.col("length") <= max_bytes) & ((F.col("length") > 0) | F.col("path").endswith("__init__.py")) & ~inside & ~paths.is_secret(rel)
    text = F.decode("content", "UTF-8")
    return found.where(ok).where(F.locate("\x00", F.decode(F.substring("content", 1, 4096), "ISO-8859-1")) == 0).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("hash"), text.alias("text"))


def git_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and their files from rows (sha, ts, author, body), the body holding ``git log --numstat`` lines."""
    files = lines.select("sha", F.explode(F.split("body", "\n")).alias("l")).select("sha", F.regexp_extract("l", r"^(\d+|-)\t(\d+|-)\t(.+)$", 1).alias("a"), F.regexp_extract("l", r"^(\d+|-)\t(\d+|-)\t(.+)$", 2).alias("d"), F.regexp_extract("l", r"^(\d+|-)\t(\d+|-)\t(.+)$", 3).alias("path")).where("path != ''")
    return lines.drop("body"), files.select("sha", "path", F.coalesce(F.expr("try_cast(a as long)"), F.lit(0)).alias("added"), F.coalesce(F.expr("try_cast(d as long)"), F.lit(0)).alias("deleted"))


def hook_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON; a field of a wrong type becomes an empty text."""
    fields = ["session_id", "hook_event_name", "prompt", "prompt_id", "last_assistant_message", "cwd"]
    return raw.select(*[F.coalesce(F.get_json_object(column, f"$.{f}"), F.lit("")).alias(f) for f in fields])
