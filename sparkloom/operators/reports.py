"""Reports over records, turns and graphs (M3-M5, G13, G15, A21, A23). Only what a report shows is brought together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import live

# Bounds of the map, the graph view and the status report.
CHARS_PER_TOKEN = 3.5
TIERS = [(10, 10), (50, 6)]
LAST_TIER = 3
SIGNATURE = 100
NO_CODE = ["json", "yaml", "toml", "markdown", "manifest", "xml", "html", "css", "text", "gradle"]
LEAST_NODES, MOST_NODES, ISOLATED = 20, 2000, 40
STALE_DAYS, WEEK = 21, 7


def file_score(rank: Column, focus: Column, seed: Column, is_test: Column, lang: Column, n_symbols: Column) -> Column:
    """Files in focus lead, seeds keep their rank, tests and files without code fall back."""
    low = F.when(is_test, 0.5).otherwise(1.0) * F.when(lang.isin(NO_CODE) | (n_symbols == 0), 0.35).otherwise(1.0)
    return F.when(focus, 2.0 + rank).when(seed, rank).otherwise(rank * low)


def repo_map(files: DataFrame, symbols: DataFrame, tokens: int = 1024) -> DataFrame:
    """(pos, path, line_no, text): the lines of the map in order, as many as fit.

    files: path, score; symbols: path, qualname, sig, line, rank. A file shows its
    path and, by its place, its 10, 6 or 3 best symbols with their owners, in
    source order. Whole files and the first lines of the next one are a prefix of
    all lines. A line has three characters or more, so no more files than a third
    of the budget can be in it: only these are sorted and joined.
    """
    budget = int(tokens * CHARS_PER_TOKEN)
    first = files.orderBy(F.desc("score"), "path").limit(budget // 3 + 1)
    placed = first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "path")))  # a bounded number of rows
    most = reduce(lambda out, t: F.when(F.col("pos") <= t[0], t[1]).otherwise(out), reversed(TIERS), F.lit(LAST_TIER))
    tiers = placed.select("path", "pos", most.alias("most"))
    own = symbols.join(F.broadcast(tiers), "path")
    best = own.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("rank"), "line", "qualname"))).where(F.col("_k") <= TIERS[0][1]).where(F.col("_k") <= F.col("most"))
    parent = F.when(F.contains(F.col("qualname"), F.lit(".")), F.regexp_replace("qualname", r"\.[^.]*$", ""))
    owners = best.select("path", parent.alias("qualname")).where("qualname is not null").distinct()
    columns = ["path", "pos", "most", "qualname", "sig", "line", "rank"]
    # an owner takes the place of a symbol: picked in rank order, owner before member, up to the tier
    picked = own.join(owners, ["path", "qualname"], "left_semi").select(*columns).unionByName(best.select(*columns)).dropDuplicates(["path", "qualname"])
    led = best.select("path", "_k", parent.alias("qualname"), F.lit(0).alias("_o")).where("qualname is not null").unionByName(best.select("path", "_k", "qualname", F.lit(1).alias("_o")))
    turn = picked.join(led.groupBy("path", "qualname").agg(F.min(F.struct("_k", "_o")).alias("_at")), ["path", "qualname"])
    kept = turn.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("_at", "qualname"))).where(F.col("_n") <= F.col("most"))
    sig = F.regexp_replace(T.squeeze(F.col("sig")), r"\s*(?:=>|\{)$", "")
    sig = F.when(F.length(sig) > SIGNATURE, F.concat(F.substring(sig, 1, SIGNATURE - 1), F.lit("…"))).otherwise(sig)
    deep = F.least(F.size(F.split("qualname", r"\.")) - 1, F.lit(3))
    lines = kept.select("pos", "path", "line", "qualname", F.concat(F.repeat(F.lit(" "), 2 * (deep + 1)), sig).alias("text"))
    heads = placed.select("pos", "path", F.lit(-1).alias("line"), F.lit("").alias("qualname"), F.concat("path", F.lit(":")).alias("text"))
    every = heads.unionByName(lines.withColumn("line", F.col("line").cast("int")))
    order = Window.orderBy("pos", "line", "qualname")  # bounded by the budget: at most 13 lines a file
    run = every.withColumn("_used", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("line", "qualname")))
    return run.where((F.col("_used") <= budget) | ((F.col("pos") == 1) & (F.col("line_no") == 1))).select(F.col("pos").cast("long").alias("pos"), "path", F.col("line_no").cast("long").alias("line_no"), "text")


def graph_view(nodes: DataFrame, edges: DataFrame, limit: int = 400) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, rank) of the highest rank with the edges (src, dst, kind) among them, counted; of nodes without an edge only the best stay."""
    limit = max(LEAST_NODES, min(limit, MOST_NODES))
    best = nodes.orderBy(F.desc("rank"), "id").limit(limit)
    ids = F.broadcast(best.select("id"))  # at most MOST_NODES rows
    kept = edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    kept = kept.groupBy("src", "dst", "kind").agg(F.count("*").alias("weight"))
    linked = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    top = best.orderBy(F.desc("rank"), "id").limit(ISOLATED).select("id")
    return best.join(linked.union(top).distinct(), "id", "left_semi"), kept


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the view as JSON for a viewer; its size is bounded by the view's."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in nodes.columns if c != "id"]))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("json"))  # one row each


def status(items: DataFrame, turns: DataFrame, now: Column) -> DataFrame:
    """M3: (part, name, value): counters of memory and of the last week, and what needs attention."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    is_ = lambda kind, s: (F.col("kind") == kind) & (F.col("status") == s)
    recent = age <= WEEK * 86400
    counts = {
        "memory.pins": is_("pin", "active"),
        "memory.critical_pins": is_("pin", "active") & F.col("priority"),
        "memory.decisions": is_("decision", "accepted"),
        "memory.rejected": is_("decision", "rejected"),
        "memory.tasks_open": is_("task", "open"),
        "memory.errors_open": is_("error", "open"),
        "memory.notes": is_("note", "active"),
        "memory.closed": ~live() & (F.col("kind") != "handoff"),
        "week.added": recent & (F.col("kind") != "handoff"),
        "week.rejected": recent & is_("decision", "rejected"),
        "attention.stale_tasks": is_("task", "open") & (age > STALE_DAYS * 86400),
        "attention.old_errors": is_("error", "open") & (age > WEEK * 86400),
    }
    said = {"week.turns": recent, "week.prompts": recent & (F.col("role") == "user")}
    one = items.agg(*[F.count_if(c).alias(k.replace(".", "__")) for k, c in counts.items()])
    two = turns.agg(*[F.count_if(c).alias(k.replace(".", "__")) for k, c in said.items()])
    both = one.crossJoin(two)  # one row each
    unguarded = F.when((F.col("memory__pins") > 0) & (F.col("memory__critical_pins") == 0), 1).otherwise(0).cast("long")
    both = both.withColumn("attention__no_critical_pins", unguarded)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c.split("__")[0]).alias("part"), F.lit(c.split("__")[1]).alias("name"), F.col(c).alias("value")) for c in both.columns])).alias("r"))
    return long.select("r.*")


def dashboard(items: DataFrame, turns: DataFrame, files: DataFrame) -> DataFrame:
    """M4: (panel, label, value): records by kind and state, turns by role, and the six languages with most files (lang)."""
    state = F.when(live(), "live").when(F.col("status") == "superseded", "superseded").otherwise("closed")
    matrix = items.groupBy(F.concat_ws(" ", "kind", state).alias("label")).agg(F.count("*").alias("value")).select(F.lit("records").alias("panel"), "label", "value")
    roles = turns.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    roles = roles.select(F.explode(F.array(F.struct(F.concat("role", F.lit(" turns")).alias("label"), F.col("n").alias("value")), F.struct(F.concat("role", F.lit(" characters")).alias("label"), F.col("chars").alias("value")))).alias("r")).select(F.lit("turns").alias("panel"), "r.*")
    langs = files.where("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(6).select(F.lit("languages").alias("panel"), "label", "value")
    return matrix.unionByName(roles).unionByName(langs)


def render(rows: DataFrame, by: str, label: str, value: str, width: int = 20) -> DataFrame:
    """M5: report rows as lines of text with bars."""
    most = F.max(value).over(Window.partitionBy(by))
    return rows.select(by, F.concat(F.rpad(label, 24, " "), F.lit(" "), F.lpad(F.col(value).cast("string"), 10, " "), F.lit(" "), T.bar(F.col(value), most, width)).alias("text"))


def fingerprint(**tables: tuple[DataFrame, str]) -> DataFrame:
    """One row that changes whenever a table (frame, stamp column) does: its count and last stamp."""
    parts = [df.agg(F.concat_ws(":", F.lit(name), F.count("*").cast("string"), F.coalesce(F.max(stamp).cast("string"), F.lit(""))).alias(f"_{name}")) for name, (df, stamp) in tables.items()]
    return reduce(DataFrame.crossJoin, parts).select(F.concat_ws("|", *[f"_{n}" for n in tables]).alias("fingerprint"))  # one row each
