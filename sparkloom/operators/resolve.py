"""Imports, mentions and directory edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

PATHISH = r"[A-Za-z0-9_./\-]+\.[A-Za-z0-9]{1,6}\b"


def suffixes(files: DataFrame) -> DataFrame:
    """(path, suffix): every run of segments up to the end of a path."""
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    return files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def links(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(page_id, href, target, how): a link resolved by exact path, then by the smallest path that ends with it, else external."""
    clean = imports.withColumn("key", F.regexp_replace("href", r"[?#].*$", ""))
    known = files.select(F.col("path").alias("exact")).distinct()
    ends = suffixes(files.select("path").distinct()).groupBy("suffix").agg(F.min("path").alias("by_suffix"))
    out = clean.join(known, F.col("key") == F.col("exact"), "left").join(ends, F.regexp_replace("key", "^/+|/+$", "") == F.col("suffix"), "left")
    how = F.when(F.col("exact").isNotNull(), "path").when(F.col("by_suffix").isNotNull(), "suffix").otherwise("external")
    return out.select("page_id", "href", F.coalesce("exact", "by_suffix").alias("target"), how.alias("how"))


def mentions(docs: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """Files that a text names, by path or by a base name that only one file has; the first ``limit`` in text order."""
    said = docs.select("id", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATHISH), F.lit(0)))).alias("pos", "name"))
    own = files.select("path").distinct()
    unique = own.groupBy(paths.base(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("by_name")).where("n = 1").drop("n")
    found = said.join(own.select(F.col("path").alias("exact")), F.col("name") == F.col("exact"), "left").join(unique, "name", "left")
    hits = found.withColumn("path", F.coalesce("exact", "by_name")).where("path is not null").groupBy("id", "path").agg(F.min("pos").alias("pos"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos", "path"))).where(F.col("rank") <= limit).select("id", "path", F.col("rank").cast("long").alias("rank"))


def directories(files: DataFrame) -> DataFrame:
    """Contains edges from each directory to what stands in it."""
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("src"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dst")))
    return files.select("path").distinct().select(F.explode(chain).alias("e")).select("e.src", "e.dst").distinct()


def file_diff(found: DataFrame, known: DataFrame) -> DataFrame:
    """New, changed and deleted files by size and time, then hash."""
    k = known.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"))
    moved = (F.col("size") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))
    change = F.when(F.col("_hash").isNull(), "new").when(F.col("hash").isNull(), "deleted").when(moved & (F.col("hash") != F.col("_hash")), "changed")
    return found.join(k, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "change")


PYTHON_FACTS = "path string, lang string, symbols array<struct<name:string,qualname:string,kind:string,line:int,end_line:int>>, imports array<struct<raw:string,level:int,line:int>>, calls array<string>, loc int, error string"


def python_facts(files: DataFrame) -> DataFrame:
    """Symbols, imports and calls of Python sources (path, text), by the standard parser; a broken file gives its error."""
    import ast
    from collections.abc import Iterator

    import pandas as pd

    def one(path: str, text: str) -> tuple:
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError) as e:
            return path, "python", [], [], [], len((text or "").splitlines()), str(e)
        symbols, imports, calls = [], [], []

        def visit(node, scope: tuple[str, ...]) -> None:
            for child in ast.iter_child_nodes(node):
                inner = scope
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                    inner = (*scope, child.name)
                    symbols.append({"name": child.name, "qualname": ".".join(inner), "kind": kind, "line": child.lineno, "end_line": child.end_lineno})
                elif isinstance(child, ast.Import):
                    imports.extend({"raw": a.name, "level": 0, "line": child.lineno} for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    imports.append({"raw": child.module or "", "level": child.level, "line": child.lineno})
                elif isinstance(child, ast.Call):
                    calls.append(ast.unparse(child.func)[:80])
                visit(child, inner)

        visit(tree, ())
        return path, "python", symbols, imports, sorted(set(calls)), len((text or "").splitlines()), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, t) for p, t in zip(batch["path"], batch["text"], strict=True)], columns=["path", "lang", "symbols", "imports", "calls", "loc", "error"])

    return files.select("path", "text").mapInPandas(run, PYTHON_FACTS)


def near(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of the candidates (frm, path) the one that shares most leading folders, then the smallest path."""
    a, b = F.split("frm", "/"), F.split("path", "/")
    same = F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")))["n"]
    return candidates.groupBy(*by).agg(F.min_by("path", F.struct(-shared, "path")).alias("path"))
