"""One project store as an object: every command is a method that returns a DataFrame, and nothing is changed in place.

Every writing command stores its result (``graph.cut``), so that plans stay short.

Commands that write return the new rows or the whole new table; ``save`` writes
tables as Parquet. ``now`` is always given, so that a run can be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions import text as T
from .operators import facts, folding, graph, lifecycle, pack, reports, resolve, retrieval
from .sources.snapshots import Snapshots
from .sources.tables import STATUSES, live

ITEM = "id long, source string, kind string, status string, priority boolean, text string, title string, superseded_by long, created_at timestamp_ntz"
TURN = "id long, session_id string, role string, text string, hash string, prompt_id long, created_at timestamp_ntz"
FOLD = "id long, title string, text string, created_at timestamp_ntz"
#: What a new record of a command is: (kind, status).
RECORDS = {"decide": ("decision", "accepted"), "reject": ("decision", "rejected"), "pin": ("pin", "active"), "task": ("task", "open"), "error": ("error", "open"), "note": ("note", "active"), "handoff": ("handoff", "active")}


@dataclass(frozen=True)
class Engine:
    """items, turns and folds have the columns above; files (path, text) and edges (src, dst, kind, weight) are optional."""

    items: DataFrame
    turns: DataFrame
    folds: DataFrame
    files: DataFrame | None = None
    edges: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession) -> Engine:
        return Engine(*[spark.createDataFrame([], s) for s in (ITEM, TURN, FOLD)])

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Engine:
        """The tables of the last commit; columns that an older store lacks are null, a newer store is refused."""
        stored = Snapshots(spark, folder)
        return Engine(*[stored.read(n, schema) for n, schema in (("items", ITEM), ("turns", TURN), ("folds", FOLD))])

    def save(self, folder: str) -> int:
        """Write the three tables as one commit, which appears at once; the number of the commit. Nothing is overwritten."""
        return Snapshots(self.items.sparkSession, folder).commit({n: getattr(self, n) for n in ("items", "turns", "folds")})

    # reading
    def search(self, query: str, limit: int = 12, kinds: list[str] | None = None, everything: bool = False) -> DataFrame:
        """Records, folds and turns for a query, fused by rank."""
        spark = self.items.sparkSession
        asked = spark.createDataFrame([(0, query)], "query_id int, query string")
        items = self.items.where(F.col("kind").isin(kinds)) if kinds else self.items
        items = items if everything else items.where(live())
        each = {"item": items.withColumn("text", F.concat_ws(" ", "title", "text")), "fold": self.folds, "turn": self.turns}
        ranked = {n: retrieval.top(retrieval.bm25(df, asked, "id", "text"), 2 * limit, F.desc("score"), F.col("id")) for n, df in each.items()}
        return retrieval.fuse(ranked, limit).drop("query_id")

    def show(self, label: str) -> DataFrame:
        """The record of a label such as D12 with its replacements; a number means any kind."""
        named = T.id_text(F.col("kind"), F.col("id")) == label.upper()
        chosen = F.col("id") == int(label) if label.isdigit() else named
        return self.items.where(chosen).join(lifecycle.supersession(self.items).select("id", "by_status", "replaces"), "id")

    def around(self, turn: int, n: int = 2) -> DataFrame:
        return lifecycle.neighbours(self.turns, self.turns.where(F.col("id") == turn).select("id"), n)

    def brain(self, now: Column, budget: int = 6000, query: str | None = None, files: tuple[str, ...] = ()) -> DataFrame:
        """The text for a new session of each project."""
        related = None
        if query:
            asked = self.items.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
            related = retrieval.bm25(self.items, asked, "id", "text").join(self.items.select("id", "source"), "id")
        return pack.build(self.items, now, "source", budget, files, related)

    def similar(self, text: str, limit: int = 3) -> DataFrame:
        asked = self.items.sparkSession.createDataFrame([(0, text)], "query_id int, query string")
        hits = retrieval.similar(self.items.where(live()).select("id", F.concat_ws(" ", "title", "text").alias("text")), asked)
        return retrieval.top(hits, limit, F.desc("shared"), F.col("id")).select("id", "shared")

    # writing
    def record(self, command: str, text: str, now: Column, project: str = "", replaces: int | None = None, critical: bool = False, patterns: list[str] | None = None) -> Engine:
        """A new record; secrets are removed, and the one it replaces is superseded by it (so are active handoffs by a handoff)."""
        kind, status = RECORDS[command]
        last = self.items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        body = T.redact(F.lit(text), patterns)
        new = last.select((F.col("last") + 1).alias("id"), F.lit(project).alias("source"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), F.lit(critical).alias("priority"), body.alias("text"), T.derive_title(body).alias("title"), F.lit(None).cast("long").alias("superseded_by"), now.alias("created_at"))
        gone = F.lit(False)
        if replaces is not None:
            gone = (F.col("id") == replaces) & (F.col("kind") == kind)
        if kind == "handoff":
            gone = gone | ((F.col("kind") == "handoff") & (F.col("status") == "active") & (F.col("source") == project))
        old = self.items.crossJoin(F.broadcast(last))  # one row
        old = old.withColumns({"status": F.when(gone, "superseded").otherwise(F.col("status")), "superseded_by": F.when(gone, F.col("last") + 1).otherwise(F.col("superseded_by"))}).select(*self.items.columns)
        schema = self.items.schema
        return replace(self, items=graph.cut(old.unionByName(new.select(*self.items.columns)).to(schema)))

    def close(self, verb: str, *ids: int) -> tuple[Engine, DataFrame]:
        """``done`` or ``drop``; the second value has one row per id with what became of it."""
        asked = self.items.sparkSession.createDataFrame([(i, verb) for i in ids], "id long, verb string")
        found = lifecycle.close(self.items, asked, live())
        new = found.where("error is null").select("id", F.col("status").alias("_new"))
        items = self.items.join(new, "id", "left").withColumn("status", F.coalesce("_new", "status")).select(*self.items.columns)
        return replace(self, items=graph.cut(items)), graph.cut(found)

    def forget(self, *ids: int, session: str | None = None) -> Engine:
        spark = self.items.sparkSession
        items = lifecycle.forget(self.items, spark.createDataFrame([(i,) for i in ids], "id long")).select(*self.items.columns)
        turns = self.turns.where(~F.col("session_id").eqNullSafe(F.lit(session))) if session else self.turns
        return replace(self, items=graph.cut(items), turns=turns)

    def capture(self, turns: DataFrame) -> Engine:
        """New turns; those already there and blank ones are left out."""
        new = turns.withColumn("hash", F.sha1("text"))
        return replace(self, turns=graph.cut(lifecycle.dedupe_turns(self.turns.unionByName(new.select(*self.turns.columns)), ["id"])))

    def fold(self, title: str, text: Column | str, now: Column) -> Engine:
        body = F.lit(text) if isinstance(text, str) else text
        new = self.folds.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).select((F.col("last") + 1).alias("id"), F.lit(title).alias("title"), body.alias("text"), now.alias("created_at"))
        return replace(self, folds=graph.cut(self.folds.unionByName(new)))

    def unfold(self, fold: int, lines: tuple[int, int] | None = None, grep: list[str] | None = None, context: int = 0) -> DataFrame:
        rows = folding.numbered(self.folds.where(F.col("id") == fold), "id", "text")
        if grep:
            return folding.grep(rows, grep, context)
        return folding.unfold(rows, *lines) if lines else rows.select("id", "line_no", "line")

    def gc(self, cutoff: Column) -> Engine:
        """Turns older than the cut-off go; records stay."""
        return replace(self, turns=lifecycle.prune(self.turns, "created_at", cutoff))

    # code
    def index(self) -> DataFrame:
        """Facts of all files: Python by the standard parser, a broken one and other languages by the scanner."""
        named = self.files.withColumn("lang", paths.language(F.col("path")))
        python = resolve.python_facts(named.where("lang = 'python'"))
        parsed = python.where("error is null").select("path", F.lit("python").alias("lang"), F.transform("symbols", lambda s: F.struct(s["name"], s["qualname"], s["kind"], s["line"], s["end_line"])).alias("symbols"), "loc")
        broken = named.join(python.where("error is not null").select("path"), "path", "left_semi")
        scanned = facts.source_facts(named.where("lang <> 'python'").unionByName(broken))
        scanned = scanned.select("path", "lang", F.transform("symbols", lambda s: F.struct(s["name"], s["qualname"], s["kind"], s["line"], s["end_line"])).alias("symbols"), "loc")
        return parsed.unionByName(scanned)

    def map(self, ranks: DataFrame | None = None, tokens: int = 1024) -> DataFrame:
        """The repository map; ranks: path, rank."""
        indexed = graph.cut(self.index())
        ranked = indexed if ranks is None else indexed.join(ranks, "path", "left")
        rank = F.lit(1.0) if ranks is None else F.coalesce("rank", F.lit(0.0))
        score = reports.file_score(rank, F.lit(False), F.lit(False), paths.is_test(F.col("path")), F.col("lang"), F.size("symbols"))
        symbols = indexed.select("path", F.explode("symbols").alias("s")).select("path", "s.qualname", F.concat_ws(" ", "s.kind", "s.name").alias("sig"), "s.line", F.lit(0.0).alias("rank"))
        return reports.repo_map(ranked.select("path", score.alias("score")), symbols, tokens)

    def graph(self, nodes: DataFrame, limit: int = 400) -> DataFrame:
        return reports.to_json(*reports.graph_view(nodes, self.edges, limit))

    def impact(self, *start, depth: int = 3) -> DataFrame:
        kind = self.edges.schema["src"].dataType.simpleString()
        return graph.impact(self.edges, self.edges.sparkSession.createDataFrame([(s,) for s in start], f"id {kind}"), depth)

    # reports
    def status(self, now: Column) -> DataFrame:
        return reports.status(self.items, self.turns, now)

    def dash(self) -> DataFrame:
        if self.files is None:
            langs = self.items.where(F.lit(False)).select(F.lit("").alias("lang"))
        else:
            langs = self.files.select(F.nullif(paths.language(F.col("path")), F.lit("")).alias("lang"))
        return reports.dashboard(self.items, self.turns, langs)

    @staticmethod
    def statuses(kind: str) -> list[str]:
        return STATUSES[kind]


def register(spark: SparkSession) -> list[str]:
    """Install the scalar functions for SQL as temporary SQL functions, which Catalyst inlines; the names are returned."""
    bodies = {
        "est_tokens": ("t STRING", "BIGINT", "CAST(floor(length(t) / 3.5) + 1 AS BIGINT)"),
        "squeeze": ("t STRING", "STRING", r"trim(regexp_replace(t, '\\s+', ' '))"),
        "record_key": ("kind STRING, t STRING", "STRING", r"concat_ws('|', kind, lower(trim(regexp_replace(t, '\\s+', ' '))))"),
        "is_live": ("kind STRING, status STRING", "BOOLEAN", "(kind IN ('pin','note','handoff') AND status = 'active') OR (kind = 'decision' AND status IN ('accepted','rejected')) OR (kind IN ('task','error') AND status = 'open')"),
        "rrf": ("rank BIGINT, weight DOUBLE", "DOUBLE", "weight / (20 + rank)"),
    }
    for name, (args, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(bodies)
