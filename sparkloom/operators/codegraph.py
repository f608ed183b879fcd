"""From sources to a graph of files, symbols and packages, whole or where files changed.

Nodes are named: ``f:path``, ``s:path::qualname``, ``d:folder`` and ``x:package``. Facts
are parsed for each file alone; edges follow from the facts of all files by joins, and
are compared with those that hold. An index keeps facts, edges and journal as
snapshots: ``touch`` parses only files whose content changed and marks the edges
as stale, ``resolved`` renews them when they are asked for.

Defined results: a null text is an empty file; of several rows with one path the
greatest text counts; a Python file with an error is read by the scanner and keeps its error; an
empty set of files gives empty tables.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.snapshots import Snapshots
from ..storage import store
from . import facts, graph, imports, louvain, names, pyfacts, resolve

STANDARD = sorted(sys.stdlib_module_names)
SYMBOLS_LISTED = 25  # fixed value: symbols of each sort that a journal entry lists
EDGE = "src string, dst string, kind string, weight double"


# --------------------------------------------------------------------- facts
def _one(path: str, lang: str, text: str | None) -> tuple:
    text = text or ""
    found = pyfacts.one(path, text) if lang == "python" else None
    if found and found[-1] is None:
        return found
    symbols, bases, calls, entry = facts.scan(text, lang)
    lines = text.splitlines()
    qualnames = {s["qualname"] for s in symbols}
    for s in symbols:
        above = s["qualname"].rpartition(".")[0]
        s |= {"doc": pyfacts.short(facts.doc_above(lines, s["line"]), pyfacts.DOC), "hash": pyfacts.body_hash(lines, s["line"], s["end_line"]), "parent": above if above in qualnames else None, "decorators": []}
    own = [{"raw": i["raw"], "level": 0, "line": i["line"], "rule": i["rule"], "names": i["names"]} for i in imports.imports_of(path, lang, text)]
    return path, lang, "", len(lines), entry, pyfacts.numbered(symbols), own, calls, bases, [], found[-1] if found else None


def parse(files: DataFrame) -> DataFrame:
    """Facts of (path, text), with ``hash``, the SHA-1 of the text."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*_one(p, lang or "", t), h) for p, lang, t, h in zip(batch["path"], batch["lang"], batch["text"], batch["hash"], strict=True)]
            yield pd.DataFrame(rows, columns=[*pyfacts.NAMES, "hash"])

    one = files.groupBy("path").agg(F.max("text").alias("text"))
    named = one.select("path", paths.language(F.col("path")).alias("lang"), "text", F.sha1(F.coalesce("text", F.lit(""))).alias("hash"))
    return named.mapInPandas(run, f"{pyfacts.FACTS}, hash string")


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "lang", F.explode("symbols").alias("s")).select("path", "lang", "s.*")


def symbol_diff(old: DataFrame, new: DataFrame, most: int = SYMBOLS_LISTED) -> DataFrame:
    """(path, added, changed, removed): of each file the symbols that are new, have another body, or went, in order of their lines."""
    a = old.select("path", "qualname", F.col("hash").alias("_a"), F.col("line").alias("_al"))
    b = new.select("path", "qualname", F.col("hash").alias("_b"), F.col("line").alias("_bl"))
    both = a.join(b, ["path", "qualname"], "full_outer")
    sort = F.when(F.col("_al").isNull(), "added").when(F.col("_bl").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    rows = both.select("path", F.struct(F.coalesce("_bl", "_al").alias("line"), "qualname").alias("s"), sort.alias("sort")).where("sort is not null")

    def listed(name: str):
        own = F.slice(F.array_sort(F.collect_list(F.when(F.col("sort") == name, F.col("s")))), 1, most)
        return F.transform(own, lambda s: s["qualname"]).alias(name)

    return rows.groupBy("path").agg(listed("added"), listed("changed"), listed("removed"))


# --------------------------------------------------------------------- edges
def _python(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.explode("imports").alias("i")).where("i.rule = 'python'").select("path", "i.line", F.col("i.raw").alias("module"), "i.level", F.explode("i.names").alias("n"))
    return rows.select("path", "line", "module", "level", F.when(F.col("n.name") != pyfacts.MODULE, F.col("n.name")).alias("name"), F.col("n.alias").alias("alias"))


def file_imports(parsed: DataFrame, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, how, target, rule) of all imports, and (path, alias, to_path, symbol) of the names they bind."""
    files = parsed.select("path")
    python = store(names.python_imports(_python(parsed), files, STANDARD), "python-imports")
    rows = parsed.select("path", F.explode("imports").alias("i")).where("i.rule <> 'python'").select("path", "i.*")
    other = store(imports.resolve(rows, files, projects), "other-imports")
    found = python.select("path", "how", "target", F.lit("python").alias("rule")).unionByName(other.select("path", "how", "target", "rule"))
    bound = other.where("how = 'file'").select("path", "target", F.explode("names").alias("n"))
    # a default export is looked up by the name it gets here
    symbol = F.when(F.col("n.name") == "default", F.col("n.alias")).when(F.col("n.name") != pyfacts.MODULE, F.col("n.name"))
    aliases = python.where("how = 'file'").select("path", "alias", F.col("target").alias("to_path"), "symbol").unionByName(bound.select("path", F.col("n.alias").alias("alias"), F.col("target").alias("to_path"), symbol.alias("symbol")))
    return found.where("how <> 'none'").distinct(), aliases.distinct()


def edges(parsed: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, weight): contains, imports, depends, calls, inherits and references, each the heaviest."""
    parsed = store(parsed, "facts")
    found, aliases = (store(df, n) for df, n in zip(file_imports(parsed, projects), ("imports", "aliases"), strict=True))
    own = store(symbols(parsed).select("path", "qualname", "name", "kind", "parent"), "symbols")
    of_test = F.when(paths.is_test(F.col("path")), names.TEST_WEIGHT).otherwise(1.0)
    file = F.concat(F.lit("f:"), "path")

    def symbol(path: str, qualname: str):
        return F.concat(F.lit("s:"), path, F.lit("::"), qualname)

    def rows(df: DataFrame, src, dst, kind: str, weight) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), weight.cast("double").alias("weight"))

    one = F.lit(1.0)
    top = F.when(F.col("src") == "", ".").otherwise(F.col("src"))
    dirs = resolve.directories(parsed.select("path")).join(parsed.select(F.col("path").alias("dst"), F.lit(True).alias("_file")), "dst", "left")
    out = [
        rows(dirs, F.concat(F.lit("d:"), top), F.concat(F.when(F.col("_file"), "f:").otherwise("d:"), "dst"), "contains", one),
        rows(own, F.coalesce(symbol("path", "parent"), file), symbol("path", "qualname"), "contains", one),
        rows(found.where("how = 'file'"), file, F.concat(F.lit("f:"), "target"), "imports", of_test),
        rows(found.where("how = 'package'"), file, F.concat(F.lit("x:"), "target"), F.when(F.col("rule") == "dep", "depends").otherwise("imports"), of_test),
    ]
    inside = parsed.select(F.col("path").alias("to_path"), names.folder(F.col("path")).alias("target")).where("not to_path like '%\\_test.go'")
    some = inside.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("to_path"))).where(F.col("_n") <= imports.FOLDER_FILES)
    out.append(rows(found.where("how = 'dir'").join(some, "target"), file, F.concat(F.lit("f:"), "to_path"), "imports", 0.5 * of_test))
    bases = parsed.select("path", F.explode("bases").alias("b")).select("path", "b.qualname", "b.base")
    asked = parsed.select("path", F.explode("calls").alias("c")).select("path", "c.owner", "c.raw")
    declared = asked.join(own.select("path", F.col("qualname").alias("owner"), F.lit(True).alias("_known")), ["path", "owner"], "left")
    called = names.calls(asked, own, bases, aliases).join(declared.select("path", "owner", "raw", "_known").distinct(), ["path", "owner", "raw"])
    out.append(rows(called, F.when(F.col("_known"), symbol("path", "owner")).otherwise(file), symbol("to_path", "to_name"), "calls", F.col("weight")))
    heirs = bases.join(names.types(bases.select("path", F.col("base").alias("raw")), own, aliases).withColumnRenamed("raw", "base"), ["path", "base"])
    out.append(rows(heirs, symbol("path", "qualname"), symbol("to_path", "to_name"), "inherits", of_test))
    refs = parsed.select("path", F.explode("refs").alias("name"))
    out.append(rows(names.references(refs, own, aliases), file, symbol("to_path", "to_name"), "references", F.col("weight")))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return graph.strongest(every)


# --------------------------------------------------------------------- seeds
# What a focus file, the file of a hit and the hit itself weigh in a personal rank.
FOCUS, OF_FILE, OF_SYMBOL = 1.0, 0.6, 0.4


def seeds(focus: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, p): teleport weights from focus files (path) and hits (path, qualname, score); a file's own hit has a null qualname.

    A hit gives its file 0.6 of its score over the best score, and the symbol 0.4 of
    that; weights of one node add up.
    """
    best = hits.agg(F.max("score").alias("_top"))  # one row
    own = hits.crossJoin(F.broadcast(best)).withColumn("p", OF_FILE * F.coalesce(F.try_divide("score", "_top"), F.lit(0.0)))
    file = own.select(F.concat(F.lit("f:"), "path").alias("id"), "p")
    symbol = own.where("qualname is not null").select(F.concat(F.lit("s:"), "path", F.lit("::"), "qualname").alias("id"), (OF_SYMBOL * F.col("p")).alias("p"))
    named = focus.select(F.concat(F.lit("f:"), "path").alias("id")).distinct().withColumn("p", F.lit(FOCUS))
    return named.unionByName(file).unionByName(symbol).groupBy("id").agg(F.sum("p").alias("p"))


# --------------------------------------------------------------------- index
JOURNAL = "scan long, path string, change string, loc int, added array<string>, changed array<string>, removed array<string>"


@dataclass
class CodeIndex:
    """An index in a folder that all executors share."""

    spark: SparkSession
    folder: str

    def open(self) -> Snapshots:
        return Snapshots(self.spark, self.folder)

    def facts(self) -> DataFrame:
        return self.open().read("facts", f"{pyfacts.FACTS}, hash string")

    def touch(self, files: DataFrame, gone: DataFrame | None = None, at: str | None = None) -> int:
        """Files (path, text) that may have changed, and paths (path) that are no more; the number parsed or removed.

        A file whose text has the hash it had is not parsed. The edges are stale afterwards.
        """
        snapshots = self.open()
        old = snapshots.read("facts", f"{pyfacts.FACTS}, hash string")
        one = files.groupBy("path").agg(F.max("text").alias("text"))
        fresh = one.join(old.select("path", F.col("hash").alias("_h")), "path", "left").where(~F.sha1(F.coalesce("text", F.lit(""))).eqNullSafe(F.col("_h"))).select("path", "text")
        parsed = store(parse(fresh), "parsed")
        lost = old.select("path").limit(0) if gone is None else gone.select("path").distinct().join(one.select("path"), "path", "left_anti").join(old.select("path"), "path", "left_semi")
        lost = store(lost, "lost")
        n = parsed.count() + lost.count()
        if not n:
            return 0
        changed = parsed.select("path").unionByName(lost)
        now = old.join(changed, "path", "left_anti").unionByName(parsed)
        scan = snapshots.meta.get("scan", 0) + 1
        entry = self._journal(scan, old, parsed, lost)
        journal = snapshots.read("journal", JOURNAL).unionByName(entry)
        snapshots.commit({"facts": now, "journal": journal}, {"stale": True, "scan": scan} | ({"last_change": at} if at else {}))
        return n

    def _journal(self, scan: int, old: DataFrame, parsed: DataFrame, lost: DataFrame) -> DataFrame:
        before = old.join(parsed.select("path"), "path", "left_semi")
        diff = symbol_diff(symbols(before), symbols(parsed))
        rows = parsed.join(before.select("path", F.lit(True).alias("_was")), "path", "left").join(diff, "path", "left")
        found = rows.select(F.lit(scan).cast("long").alias("scan"), "path", F.when(F.col("_was"), "modify").otherwise("add").alias("change"), "loc", "added", "changed", "removed")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("loc", "int"), ("added", "array<string>"), ("changed", "array<string>"), ("removed", "array<string>"))]
        return found.unionByName(lost.select(F.lit(scan).cast("long").alias("scan"), "path", F.lit("delete").alias("change"), *none))

    def sync(self, files: DataFrame, at: str | None = None) -> dict:
        """The index after a whole listing: what is not in it is gone; edges are renewed. What was done is returned."""
        known = self.facts().select("path")
        n = self.touch(files, known.join(files.select("path").distinct(), "path", "left_anti"), at)
        ran = self.ensure_resolved()
        meta = self.open().meta
        last = self.journal().where(F.col("scan") == meta.get("scan", 0)) if n else None
        by = {r.change: r["count"] for r in last.groupBy("change").count().collect()} if n else {}
        return {"changed": n, "added": by.get("add", 0), "modified": by.get("modify", 0), "deleted": by.get("delete", 0), "resolved": ran, "scan": meta.get("scan", 0)}

    def journal(self) -> DataFrame:
        return self.open().read("journal", JOURNAL)

    def ensure_resolved(self, projects: DataFrame | None = None) -> bool:
        """Renew the edges if they are stale; whether that was so."""
        snapshots = self.open()
        if not snapshots.meta.get("stale", not snapshots.has("edges")):
            return False
        now = edges(snapshots.read("facts", f"{pyfacts.FACTS}, hash string"), projects)
        snapshots.commit({"edges": now}, {"stale": False})
        return True

    def edges(self) -> DataFrame:
        self.ensure_resolved()
        return self.open().read("edges", EDGE)

    def ranks(self) -> DataFrame:
        """(id, rank, community) of all nodes, stored with the edges they come from."""
        self.ensure_resolved()
        snapshots = self.open()
        source = snapshots.state["tables"]["edges"]
        if snapshots.meta.get("ranks_of") != source:
            found = snapshots.read("edges", EDGE)
            of = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            kind = F.when(F.col("id").startswith("f:"), "file").when(F.col("id").startswith("d:"), "dir").when(F.col("id").startswith("x:"), "package")
            declared = symbols(snapshots.read("facts", f"{pyfacts.FACTS}, hash string")).select(F.concat(F.lit("s:"), "path", F.lit("::"), "qualname").alias("id"), F.col("kind").alias("_kind"))
            nodes = store(of.join(declared, "id", "left").select("id", F.coalesce(kind, "_kind").alias("kind")), "nodes")
            rank = graph.pagerank(nodes, graph.structural(found))
            part = louvain.file_communities(nodes, found)
            snapshots.commit({"ranks": nodes.select("id").join(rank, "id", "left").join(part, "id", "left")}, {"ranks_of": source})
        return self.open().read("ranks", "id string, rank double, community string")

    def follow(self, changes: DataFrame, checkpoint: str):
        """T11 as a stream: (path, text) of changed files, a null text for one that is gone; each micro-batch is one commit."""

        def batch(df: DataFrame, number: int) -> None:
            rows = store(df, "changes")
            self.touch(rows.where("text is not null"), rows.where("text is null").select("path"))

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
