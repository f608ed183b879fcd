"""The text a new session starts with (M1, M2, A23): sections of records under a budget of characters, one text a project.

A row is taken if it still fits; one that does not is skipped, and a shorter one
after it may be taken. Of rows of one length in a section only the first
``budget / (length + 1)`` can ever be taken, as room only shrinks within a
section: no more of them reach the ordered scan, so what a task gathers for a
project is bounded by the budget, whatever the project holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import live

# Bounds of the text and of its sections.
LEAST, MOST = 400, 9000
HANDOFF_CHARS, CRITICAL_CHARS, ITEM_CHARS, TITLE_CHARS = 700, 300, 160, 48
REJECTED, TASKS, ERRORS, RELATED, PINNED, DECISIONS = 10, 8, 5, 6, 12, 8
STALE_DAYS, INDEX_SHARE = 21, 0.2
#: Kept free for the line that counts what is not shown.
MORE_ROOM = 20
SALTS = 64
FOOTER = "-- search <words> | show <id> | map"
INDEX_TITLE = "## More"


def focus_score(text: Column, files: list[str]) -> Column:
    """M2: how many of the files a text names, by a base name of four characters or more."""
    names = [f.rsplit("/", 1)[-1] for f in files]
    return sum((F.contains(text, F.lit(n)).cast("int") for n in names if len(n) >= 4), F.lit(0))


def _first(rows: DataFrame, by: list[str], most: int, *order: Column) -> DataFrame:
    """The first rows of each group; those of ``SALTS`` parts of it first, so that no task sorts all of a large group."""
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)


def rows(items: DataFrame, now: Column, by: str, budget: int, files: list[str], related: DataFrame | None) -> DataFrame:
    """(by, section, ord, id, title, line, most): what may be shown, in order; section 8 is the index."""
    newest = [F.desc("created_at"), F.desc("id")]
    label = T.id_text(F.col("kind"), F.col("id"))
    stale = (F.col("kind") == "task") & (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")) > STALE_DAYS * 86400)
    held = items.where(live())
    entry = lambda chars: F.concat(F.lit("- "), label, F.lit(" "), T.truncate(F.col("text"), chars))

    def section(number: int, df: DataFrame, title, line: Column, most: int, *order: Column, spare: int = 0) -> DataFrame:
        title = F.lit(title) if isinstance(title, str) else title
        placed = _first(df, [by], most + spare, *order)
        return placed.select(by, F.lit(number).alias("section"), F.col("_n").alias("ord"), "id", title.alias("title"), line.alias("line"), F.lit(most).alias("most"))

    hand = held.where("kind = 'handoff'")
    pins, decisions = held.where("kind = 'pin'"), held.where("kind = 'decision'")
    spare = RELATED if related is not None else 0
    parts = [section(1, hand, F.concat(F.lit("## Last handoff "), label, F.lit(", "), T.ago(F.col("created_at"), now)), T.truncate(F.col("text"), HANDOFF_CHARS), 1, *newest)]
    # critical pins have no maximum but the budget
    critical = pins.where("priority").select(by, "id", "created_at", entry(CRITICAL_CHARS).alias("line")).withColumn("_len", F.length("line"))
    fit = _first(critical, [by, "_len"], budget // 2, *newest).where(F.col("_n") * (F.col("_len") + 1) <= budget)
    order = F.row_number().over(Window.partitionBy(by).orderBy(*newest))
    parts.append(fit.select(by, F.lit(2).alias("section"), order.alias("ord"), "id", F.lit("## Constraints").alias("title"), "line", F.lit(MOST).alias("most")))
    parts.append(section(3, decisions.where("status = 'rejected'"), "## Rejected", entry(ITEM_CHARS), REJECTED, *newest))
    tasks = section(4, held.where((F.col("kind") == "task") & ~stale), "## Open work", entry(ITEM_CHARS), TASKS, *newest)
    errors = section(4, held.where("kind = 'error'"), "## Open work", entry(ITEM_CHARS), ERRORS, *newest).withColumn("ord", F.col("ord") + TASKS)
    parts += [tasks.withColumn("most", F.lit(TASKS + ERRORS)), errors.withColumn("most", F.lit(TASKS + ERRORS))]
    if related is not None:  # (by, id, score)
        hits = held.where("kind <> 'handoff'").join(related.select(by, "id", "score"), [by, "id"])
        parts.append(section(5, hits, "## Related", entry(ITEM_CHARS), RELATED, F.desc("score"), F.desc("id"), spare=10))
    parts.append(section(6, pins.where("not priority").withColumn("_focus", focus_score(F.col("text"), files)), "## Pinned", entry(ITEM_CHARS), PINNED, F.desc("_focus"), *newest, spare=spare))
    parts.append(section(7, decisions.where("status = 'accepted'"), "## Recent decisions", entry(ITEM_CHARS), DECISIONS, *newest, spare=spare))
    mark = F.concat(label, F.when(stale, " (stale)").otherwise(""), F.when(F.col("status") == "rejected", " x").otherwise(""), F.lit(" "), T.truncate(F.col("title"), TITLE_CHARS))
    kinds = F.array_position(F.array(*map(F.lit, ["pin", "decision", "task", "error", "note"])), F.col("kind"))
    # an index entry has six characters or more, a shown row eleven
    parts.append(section(8, held.where("kind <> 'handoff'").withColumn("_kind", kinds), INDEX_TITLE, mark, MOST, F.col("_kind"), *newest).where(F.col("ord") <= budget // 6 + budget // 11))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(items: DataFrame, now: Column, by: str = "source", budget: int = 6000, files: tuple[str, ...] = (), related: DataFrame | None = None) -> DataFrame:
    """(by, pack, chars, shown, indexed, live): one text a project, never longer than the budget.

    items: id, kind, status, priority, text, title, created_at and the project's column.
    A fifth of the budget is kept for the index when more records hold than the
    sections before it can show. The header and the footer are always there.
    """
    budget = max(LEAST, min(budget, MOST))
    held = items.groupBy(by).agg(F.count_if(live() & (F.col("kind") != "handoff")).alias("live"))
    listed = rows(items, now, by, budget, list(files), related).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("section", "ord", "id", "title", "line", "most"))).alias("_rows"))
    header = F.concat(F.lit("# Memory "), F.col(by).cast("string"))
    limit = F.lit(budget - len(FOOTER) - 2 - MORE_ROOM) - F.length("_header")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("section"), F.lit(0).alias("seen"), F.lit(False).alias("opened"), F.lit(0).alias("base"), F.lit(0).alias("indexed"), F.lit(False).alias("full"), F.array().cast("array<long>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        new = a["section"] != x["section"]
        opened, seen = ~new & a["opened"], F.when(new, 0).otherwise(a["seen"])
        base = F.when(x["section"] < 6, F.size(a["ids"])).when(a["section"] < 6, F.size(a["ids"])).otherwise(a["base"])
        index = x["section"] == 8
        reserve = F.when(x["section"].isin(6, 7) & (F.col("live") > base + PINNED + DECISIONS), F.floor(F.lit(budget) * INDEX_SHARE)).otherwise(0)
        joined = index & opened
        glue = F.when(joined, F.lit(" | ")).when(opened, F.lit("\n")).otherwise(F.concat(F.lit("\n\n"), x["title"], F.lit("\n")))
        known = F.array_contains(a["ids"], x["id"])
        fits = F.length(a["text"]) + F.length(glue) + F.length(x["line"]) <= F.col("_limit") - reserve
        take = ~known & (seen < x["most"]) & fits & ~(index & a["full"] & ~new)
        return F.struct(
            F.when(take, F.concat(a["text"], glue, x["line"])).otherwise(a["text"]).alias("text"), x["section"].alias("section"),
            F.when(known, seen).otherwise(seen + 1).alias("seen"), (opened | take).alias("opened"), base.cast("int").alias("base"),
            F.when(index & take, a["indexed"] + 1).otherwise(a["indexed"]).alias("indexed"), ((~new & a["full"]) | (~known & ~take)).alias("full"),
            F.when(take & ~index, F.array_append(a["ids"], x["id"])).otherwise(a["ids"]).alias("ids"),
        )

    done = held.join(listed, by, "left").withColumn("_header", header).withColumn("_limit", limit.cast("int")).withColumn("_a", F.aggregate(F.coalesce("_rows", F.array().cast(listed.schema["_rows"].dataType)), start, step))
    shown = F.size("_a.ids")
    more = F.col("live") - F.size(F.array_except(F.col("_a.ids"), F.transform(F.filter("_rows", lambda x: x["section"] == 1), lambda x: x["id"]))) - F.col("_a.indexed")
    tail = F.when(more > 0, F.concat(F.lit("\n+"), more.cast("string"), F.lit(" more"))).otherwise("")
    body = F.when(F.col("_a.text") == "", "\n\nNothing is recorded yet.").otherwise(F.concat("_a.text", tail))
    text = F.concat("_header", body, F.lit("\n\n" + FOOTER))
    return done.select(by, text.alias("pack"), F.length(text).cast("long").alias("chars"), shown.cast("long").alias("shown"), F.col("_a.indexed").cast("long").alias("indexed"), "live")


def reach(packs: DataFrame, items: DataFrame, by: str = "source") -> DataFrame:
    """Of the live records of a project, how many its text names."""
    named = packs.select(by, F.explode(F.array_distinct(F.regexp_extract_all("pack", F.lit(r"\b[PDTEN]\d+\b"), F.lit(0)))).alias("label"))
    held = items.where(live() & (F.col("kind") != "handoff")).select(by, T.id_text(F.col("kind"), F.col("id")).alias("label"))
    counted = held.join(named.withColumn("_named", F.lit(1)), [by, "label"], "left").groupBy(by)
    return counted.agg(F.count("*").alias("live"), F.count("_named").alias("reachable"))
