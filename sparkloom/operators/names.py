"""From the names in parsed sources to files and symbols.

Tables: files (path); imports (path, line, module, level, name, alias), ``name``
being null for a plain import; symbols (path, qualname, name, kind); bases
(path, qualname, base); calls (path, owner, raw); refs (path, name). Every step
is an equi join on names; a name with more than ``FAN_OUT`` meanings is dropped
by its count before its meanings are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .graph import cut

FAN_OUT = 3
# Kinds that a type name, a plain call and a call on an unknown receiver can mean.
TYPES = ["class", "interface", "struct", "trait", "object", "record", "protocol", "enum", "mixin"]
CALLABLE = ["function", *TYPES]
RECEIVED = ["method", "function"]
SELVES = ["self", "cls", "this", "super"]
TEST_WEIGHT = 0.35


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def probe(candidates: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Of ordered candidates (key, pos, path) the first that exists."""
    return candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy(*key).agg(F.min_by("path", "pos").alias("target"))


def packages(files: DataFrame) -> DataFrame:
    return files.where(paths.base(F.col("path")) == "__init__.py").select(folder(F.col("path")).alias("dir")).distinct()


def python_roots(files: DataFrame) -> DataFrame:
    """(root, pos): folders from which absolute imports are looked up: the top, src, lib, then parents of top packages."""
    own = packages(files)
    parents = own.select(folder(F.col("dir")).alias("root")).distinct()
    tops = parents.join(own.withColumnRenamed("dir", "root"), "root", "left_anti")
    fixed = files.sparkSession.createDataFrame([("", 0), ("src", 1), ("lib", 2)], "root string, pos int")
    return fixed.unionByName(tops.join(fixed, "root", "left_anti").withColumn("pos", F.lit(3)).select("root", "pos"))


def _above(path: Column) -> Column:
    """The folders of a path, the top (empty) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def own_roots(asking: DataFrame, files: DataFrame) -> DataFrame:
    """(path, own): the nearest folder above a file that is no package."""
    above = asking.select("path", F.posexplode(_above(F.col("path"))).alias("_depth", "dir"))
    return above.join(packages(files).where("dir <> ''"), "dir", "left_anti").groupBy("path").agg(F.max_by("dir", "_depth").alias("own"))


def _sources(stem: Column) -> Column:
    return F.array(F.concat(stem, F.lit(".py")), join_path(stem, F.lit("__init__.py")), F.concat(stem, F.lit(".pyi")))


def modules(files: DataFrame, standard: list[str]) -> DataFrame:
    """(stem, file, pos): the module files below the roots by what an absolute import calls them, the first root's file each."""
    source = files.where(F.col("path").rlike(r"\.pyi?$")).select("path").distinct()
    placed = source.select("path", F.explode(_above(F.col("path"))).alias("root")).join(python_roots(files), "root")
    inside = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substr(path, length(root) + 2)"))
    named = placed.withColumns({"stem": F.regexp_replace(inside, r"(/__init__)?\.pyi?$", ""), "_x": F.when(F.col("path").endswith("/__init__.py"), 1).when(F.col("path").endswith(".py"), 0).otherwise(2)})
    named = named.where("not path rlike '__init__\\\\.pyi$' and stem <> '__init__'").withColumn("_init", join_path(F.col("root"), F.split("stem", "/")[0], F.lit("__init__.py")))
    real = named.join(source.select(F.col("path").alias("_init"), F.lit(True).alias("_real")), "_init", "left")
    std = F.split("stem", "/")[0].isin(standard)
    real = real.where(~std | (F.contains(F.col("stem"), F.lit("/")) & F.col("_real")))
    return real.groupBy("stem").agg(F.min_by("path", F.struct("pos", "root", "_x")).alias("file"))


def python_imports(imports: DataFrame, files: DataFrame, standard: list[str]) -> DataFrame:
    """(path, line, name, alias, target, symbol, how).

    ``how`` is file, package (``target`` is its name) or none (standard library,
    or nothing relative found). ``symbol`` is null where the alias is a module. The
    longest prefix of a module wins, then the importing file's own root, then the
    order of the roots. A standard name resolves to a file only inside a real local
    package, and never by suffix. All joins are on whole paths.
    """
    rows = imports.select("path", "line", "module", "level", "name", "alias").distinct()
    rows = rows.join(own_roots(rows.select("path").distinct(), files), "path").withColumn("_k", F.struct("path", "line", "module", "level", "name", "alias"))
    parts = F.filter(F.split(F.coalesce("module", F.lit("")), r"\."), lambda p: p != "")
    up = F.split(folder(F.col("path")), "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.size(up) - F.col("level") + 1, F.lit(0))), "/")
    named = F.col("name").isNotNull()
    # what is looked up: the module itself, and the module with the name behind it as a submodule
    submodule = F.when(named & (F.col("name") != "*"), F.struct(F.lit(1).alias("sub"), F.concat(parts, F.array("name")).alias("parts")))
    wanted = F.filter(F.array(F.struct(F.lit(0).alias("sub"), parts.alias("parts")), submodule), lambda w: w.isNotNull())
    asked = rows.select("_k", "level", base.alias("_base"), "own", named.alias("_named"), F.explode(wanted).alias("w")).select("_k", "level", "_base", "own", "_named", "w.sub", "w.parts")
    known = files.select(F.col("path").alias("_file")).distinct()

    stem = join_path(F.col("_base"), F.array_join("parts", "/"))
    options = F.when(F.size("parts") == 0, F.array(join_path(F.col("_base"), F.lit("__init__.py")))).otherwise(_sources(stem))
    relative = asked.where("level > 0").select("_k", "sub", F.size("parts").alias("_len"), F.lit(0).alias("_n"), F.posexplode(options).alias("_x", "_file")).join(known, "_file", "left_semi")
    # every prefix of a plain import, the whole path of a from import
    prefixes = F.when(F.col("_named"), F.array("parts")).otherwise(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", F.lit(1), n)))
    absolute = asked.where("level = 0 and size(parts) > 0").withColumn("parts", F.explode(prefixes)).withColumns({"stem": F.array_join("parts", "/"), "_len": F.size("parts")})
    beside = absolute.where(~F.col("parts")[0].isin(standard)).select("_k", "sub", "_len", F.lit(0).alias("_n"), F.posexplode(_sources(join_path(F.col("own"), F.col("stem")))).alias("_x", "_file")).join(known, "_file", "left_semi")
    rooted = absolute.join(modules(files, standard), "stem").select("_k", "sub", "_len", F.lit(1).alias("_n"), F.lit(0).alias("_x"), F.col("file").alias("_file"))
    hits = relative.unionByName(beside).unionByName(rooted)
    best = hits.groupBy("_k", "sub").agg(F.min_by("_file", F.struct(-F.col("_len"), "_n", "_x")).alias("_file"))
    both = best.groupBy("_k").agg(F.max(F.when(F.col("sub") == 0, F.col("_file"))).alias("_mod"), F.max(F.when(F.col("sub") == 1, F.col("_file"))).alias("_sub"))

    target = F.coalesce("_sub", "_mod")
    dirs = files.where(F.contains(F.col("path"), F.lit("/"))).select(F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
    local = dirs.join(python_roots(files), folder(F.col("dir")) == F.col("root"), "left_semi").select(paths.base(F.col("dir")).alias("_top"), F.lit(True).alias("_local")).distinct()
    out = rows.join(both, "_k", "left").withColumn("_top", F.get(parts, 0)).withColumn("_beside", join_path(F.col("own"), F.col("_top")))
    out = out.join(local, "_top", "left").join(dirs.select(F.col("dir").alias("_beside"), F.lit(True).alias("_near")), "_beside", "left")
    outside = target.isNull() & (F.col("level") == 0) & ~F.col("_top").isin(standard) & F.col("_local").isNull() & F.col("_near").isNull()
    how = F.when(target.isNotNull(), "file").when(outside, "package").otherwise("none")
    return out.select("path", "line", "name", "alias", F.when(target.isNotNull(), target).when(outside, F.col("_top")).alias("target"), F.when(F.col("_sub").isNull() & named & target.isNotNull(), F.col("name")).alias("symbol"), how.alias("how"))


def _by_name(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    return symbols.where(F.col("kind").isin(kinds)).select("name", F.col("path").alias("to_path"), F.col("qualname").alias("to_name"))


def _pick(asked: DataFrame, meanings: DataFrame, imported: DataFrame, key: list[str], own: bool) -> DataFrame:
    """Up to FAN_OUT meanings of ``name`` near the asking file (imported, or ``own``), and where none is near, elsewhere: (key, near, n, to_path, to_name).

    How many meanings a name has, in a file and at all, is counted first; a name with more
    than FAN_OUT of them meets their counts only, never the meanings.
    """
    reach = imported.select("path", "to_path").distinct()
    if own:
        reach = reach.unionByName(asked.select("path", F.col("path").alias("to_path")).distinct()).distinct()
    counts = meanings.groupBy("to_path", "name").agg(F.count("*").alias("_n"))
    met = asked.select(*dict.fromkeys([*key, "path", "name"])).join(reach, "path").join(counts, ["to_path", "name"])
    close = cut(met.groupBy(*dict.fromkeys([*key, "name"])).agg(F.sum("_n").alias("n"), F.when(F.sum("_n") <= FAN_OUT, F.collect_list("to_path")).alias("_in")))
    rare = meanings.join(counts.where(F.col("_n") <= FAN_OUT).select("to_path", "name"), ["to_path", "name"], "left_semi")
    near = close.where(F.col("n") <= FAN_OUT).withColumn("to_path", F.explode("_in")).join(rare, ["to_path", "name"]).select(*key, "to_path", "to_name", "n", F.lit(True).alias("near"))
    few = meanings.join(meanings.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= FAN_OUT), "name")
    far = asked.select(*key, "name").join(few, "name").join(close.select(*key).distinct(), key, "left_anti").select(*key, "to_path", "to_name", "n", F.lit(False).alias("near"))
    return near.unionByName(far)


def types(asked: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Type names (path, raw) to (to_path, to_name): in the file, by an alias, the only imported one or the only one.

    aliases: path, alias, to_path, symbol (null: a module).
    """
    last, head = F.element_at(F.split("raw", r"\."), -1), F.split("raw", r"\.")[0]
    q = asked.select("path", "raw").distinct().withColumns({"name": last, "alias": head})
    known = symbols.select(F.col("path").alias("to_path"), F.col("qualname").alias("to_name")).distinct()
    here = q.join(known, (F.col("path") == F.col("to_path")) & (F.col("raw") == F.col("to_name"))).select("path", "raw", "to_path", "to_name", F.lit(0).alias("by"))
    al = aliases.select("path", "alias", "to_path", "symbol")
    through = q.join(al, ["path", "alias"]).withColumn("to_name", F.coalesce("symbol", "name")).join(known, ["to_path", "to_name"], "left_semi").select("path", "raw", "to_path", "to_name", F.lit(1).alias("by"))
    rest = _pick(q, _by_name(symbols, TYPES), al, ["path", "raw"], False)
    rest = rest.where((F.col("near") & (F.col("n") <= 2)) | (F.col("n") == 1)).select("path", "raw", "to_path", "to_name", F.lit(2).alias("by"))
    every = here.unionByName(through).unionByName(rest)
    return every.groupBy("path", "raw").agg(F.min(F.struct("by", "to_path", "to_name")).alias("_m")).select("path", "raw", "_m.to_path", "_m.to_name")


def ancestors(bases: DataFrame, symbols: DataFrame, aliases: DataFrame, depth: int = 3) -> DataFrame:
    """(path, qualname, to_path, to_name, step): a class and what it inherits from, up to ``depth`` steps."""
    links = bases.withColumnRenamed("base", "raw").join(types(bases.select("path", F.col("base").alias("raw")), symbols, aliases), ["path", "raw"])
    links = links.select(F.col("path").alias("_path"), F.col("qualname").alias("_name"), F.col("to_path").alias("_to"), F.col("to_name").alias("_to_name")).distinct()
    own = symbols.where(F.col("kind").isin(TYPES)).select("path", "qualname", F.col("path").alias("to_path"), F.col("qualname").alias("to_name"), F.lit(0).alias("step")).distinct()
    levels, front = [own], own
    for k in range(1, depth + 1):
        front = front.join(links, (F.col("to_path") == F.col("_path")) & (F.col("to_name") == F.col("_name"))).select("path", "qualname", F.col("_to").alias("to_path"), F.col("_to_name").alias("to_name"), F.lit(k).alias("step")).distinct()
        levels.append(front)
    return reduce(DataFrame.unionByName, levels).groupBy("path", "qualname", "to_path", "to_name").agg(F.min("step").alias("step"))


def calls(asked: DataFrame, symbols: DataFrame, bases: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, owner, raw, to_path, to_name, weight).

    In order: a method of the own class or of what it inherits from, a name of the
    file, an alias, a static call on a type; each weighs 1. Otherwise up to three
    meanings share 0.9 if some are in the file or in imported ones, else 0.6. Calls
    out of tests weigh 0.35 as much (G17). A name bound to an import means nothing else.
    """
    parts = F.split("raw", r"\.")
    key = ["path", "owner", "raw"]
    owner_class = F.when(F.contains(F.col("owner"), F.lit(".")), F.regexp_replace("owner", r"\.[^.]*$", ""))
    q = asked.select(*key).distinct().withColumns({"alias": parts[0], "name": F.element_at(parts, -1), "_n": F.size(parts), "_rest": F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "."), "_class": owner_class})
    known = symbols.select(F.col("path").alias("to_path"), F.col("qualname").alias("to_name")).distinct()
    said = F.col("alias").isin(SELVES)

    inherited = q.where(F.col("_class").isNotNull() & ((said & (F.col("_n") == 2)) | (F.col("_n") == 1)))
    lineage = ancestors(bases, symbols, aliases).select("path", F.col("qualname").alias("_class"), "to_path", F.col("to_name").alias("_base"), "step")
    own = inherited.join(lineage, ["path", "_class"]).withColumn("to_name", F.concat_ws(".", "_base", "name")).join(known, ["to_path", "to_name"], "left_semi").select(*key, "to_path", "to_name", (F.when(F.col("_n") == 1, 1).otherwise(0) * 10 + F.col("step")).alias("by"))
    here = q.join(known, (F.col("path") == F.col("to_path")) & (F.col("raw") == F.col("to_name"))).select(*key, "to_path", "to_name", F.when(F.col("_n") == 1, 5).otherwise(25).alias("by"))
    bound = q.join(aliases.select("path", "alias", "to_path", "symbol"), ["path", "alias"])
    tries = F.when(F.col("symbol").isNull(), F.array("_rest", "name")).when(F.col("_n") == 1, F.array("symbol")).otherwise(F.array(F.concat_ws(".", "symbol", "_rest")))
    through = bound.select(*key, "to_path", F.posexplode(tries).alias("_t", "to_name")).join(known, ["to_path", "to_name"], "left_semi").select(*key, "to_path", "to_name", (F.col("_t") + 20).alias("by"))
    static = q.where(~said & (F.col("_n") == 2)).withColumnRenamed("name", "_last")
    on_type = static.join(types(static.select("path", F.col("alias").alias("raw")), symbols, aliases).select("path", F.col("raw").alias("alias"), "to_path", F.col("to_name").alias("_type")), ["path", "alias"]).withColumn("to_name", F.concat_ws(".", "_type", "_last")).join(known, ["to_path", "to_name"], "left_semi").select(*key, "to_path", "to_name", F.lit(30).alias("by"))
    exact = reduce(DataFrame.unionByName, [own, here, through, on_type]).groupBy(*key).agg(F.min(F.struct("by", "to_path", "to_name")).alias("_m")).select(*key, "_m.to_path", "_m.to_name", F.lit(1.0).alias("weight"))
    exact = cut(exact)

    closed = bound.where(F.col("symbol").isNull() | (F.col("_n") == 1)).select(*key)
    open_ = cut(q.join(exact.select(*key), key, "left_anti").join(closed.distinct(), key, "left_anti"))
    plain = _pick(open_.where("_n = 1"), _by_name(symbols, CALLABLE), aliases, key, True)
    received = _pick(open_.where("_n > 1"), _by_name(symbols, RECEIVED), aliases, key, True)
    shared = plain.unionByName(received).where(F.col("n") <= FAN_OUT)
    shared = shared.select(*key, "to_path", "to_name", (F.when(F.col("near"), 0.9).otherwise(0.6) / F.col("n")).alias("weight"))
    out = exact.unionByName(shared)
    return out.withColumn("weight", F.col("weight") * F.when(paths.is_test(F.col("path")), TEST_WEIGHT).otherwise(1.0))


def references(asked: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, name, to_path, to_name, weight): up to three imported meanings share 0.6, else the only one of a name of five letters or more weighs 0.3."""
    q = asked.select("path", "name").distinct().join(symbols.select("path", "name").distinct(), ["path", "name"], "left_anti")
    picked = _pick(q, _by_name(symbols, CALLABLE), aliases, ["path", "name"], False)
    kept = picked.where(F.when(F.col("near"), F.col("n") <= FAN_OUT).otherwise((F.col("n") == 1) & (F.length("name") > 4)))
    weight = F.when(F.col("near"), 0.6 / F.col("n")).otherwise(0.3) * F.when(paths.is_test(F.col("path")), TEST_WEIGHT).otherwise(1.0)
    return kept.select("path", "name", "to_path", "to_name", weight.alias("weight"))
