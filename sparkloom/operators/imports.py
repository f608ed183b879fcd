"""Imports of languages other than Python, and what files they mean.

``source_imports`` reads what a source imports; each import has a rule, and every
rule is a list of candidates in order of preference, computed as columns: paths that
must exist, then endings of paths, of which the file that shares most leading folders
with the importing one counts. All lookups are equi joins: paths on paths, and
endings on (ending, folder), so that a common file name meets only the files
below a folder of the asking one.

Defined results: a null text imports nothing; equal imports of a file count once for
each line; a rule that is not known finds nothing; of equally near files the smallest
path counts; a file never imports itself by an ending.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .names import folder, join_path
from .pyfacts import MODULE

IMPORTS = "path string, raw string, line int, rule string, names array<struct<name:string,alias:string>>"
# Extensions that an import may leave out, and names that are no packages of a project.
JS_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", ".mts", ".cts"]
JS_OUTPUT, JS_INPUT = r"\.(js|jsx|mjs|cjs)$", [".ts", ".tsx", ".mts", ".cts"]
PATH_ENDINGS = ["", ".rb", ".php", ".md", ".sh"]
NODE_BUILTINS = ["fs", "path", "os", "http", "https", "url", "util", "crypto", "stream", "events", "child_process", "assert", "buffer", "net", "zlib", "readline", "tty", "dns", "cluster", "module", "process", "querystring", "string_decoder", "timers", "vm", "worker_threads", "perf_hooks", "fs/promises"]
RUST_BUILTINS, RUST_LOCAL = ["std", "core", "alloc"], ["crate", "self", "super"]
JVM_BUILTINS = r"^(java\.|javax\.|kotlin\.|scala\.|System|Microsoft)"
SWIFT_BUILTINS = ["Foundation", "UIKit", "SwiftUI", "Combine", "Swift", "CoreData", "CoreGraphics", "XCTest", "AppKit"]
#: At most so many files of an imported Go folder.
FOLDER_FILES = 40

# ------------------------------------------------------------------- reading
_JS = re.compile(r"""(?P<head>(?:\bimport\b|\bexport\b|\b(?:const|let|var)\b)[^;'"()]*?)?(?:\bfrom\s*|\bimport\s*\(?\s*|=?\s*\brequire\s*\(\s*)['"](?P<raw>[^'"\n]+)['"]""")
_PLAIN = {
    "java": ("java", re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?", re.M)),
    "csharp": ("csharp", re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M)),
    "c": ("c", re.compile(r'^\s*#\s*include\s+"([^"\n]+)"', re.M)),
    "bitbake": ("bb", re.compile(r"^\s*(?:require|include)\s+(\S+)", re.M)),
    "shell": ("path", re.compile(r"^\s*(?:source|\.)\s+[\"']?([^\s\"';$]+)", re.M)),
    "dart": ("dart", re.compile(r"""^\s*(?:import|export|part)\s+['"]([^'"\n]+)['"]""", re.M)),
    "swift": ("swift", re.compile(r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?(\w+)", re.M)),
}
_PLAIN |= {"kotlin": _PLAIN["java"], "scala": _PLAIN["java"], "cpp": _PLAIN["c"], "devicetree": _PLAIN["c"]}
_RUBY = re.compile(r"""^\s*require(_relative)?\s*\(?\s*['"]([^'"\n]+)['"]""", re.M)
_PHP_USE, _PHP_FILE = re.compile(r"^\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+)(?:\s+as\s+(\w+))?\s*;", re.M), re.compile(r"""\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['"]/?([^'"\n]+)['"]""")
_RUST_MOD, _RUST_USE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", re.M), re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M)
_GO = re.compile(r'^\s*import\s*(?:\((?P<many>.*?)^\s*\)|(?P<one>[^\n(]*"[^"\n]+"))', re.M | re.S)
_LINK = re.compile(r"\]\(([^)\s#?:]+)[^)]*\)")


def _named(part: str) -> list[tuple[str, str]]:
    """a, b as c  to names and aliases; also b: c."""
    out = []
    for item in part.split(","):
        words = re.split(r"\s+as\s+|\s*:\s*", item.strip())
        if re.fullmatch(r"(type\s+)?[\w$]+", words[0]):
            name = words[0].split()[-1]
            out.append((name, words[-1].strip() if len(words) > 1 else name))
    return out


def _js_names(head: str) -> list[tuple[str, str]]:
    body = re.sub(r"^\s*(import|export|const|let|var)\b(\s+type\b)?", "", head).strip()
    required = not re.match(r"\s*(import|export)\b", head)
    inner = re.search(r"\{([^}]*)\}", body)
    out = _named(inner.group(1)) if inner else []
    rest = re.sub(r"\{[^}]*\}", "", body)
    if m := re.search(r"\*\s*as\s+([\w$]+)", rest):
        out.append((MODULE, m.group(1)))
    elif m := re.match(r"\s*([\w$]+)", rest):
        out.append((MODULE if required else "default", m.group(1)))
    return out


def _rust_paths(tree: str) -> Iterator[tuple[str, str]]:
    """The paths of a use tree with what they are called."""
    tree = " ".join(tree.split())
    if "{" in tree:
        before, _, inside = tree.partition("{")
        depth, part = 0, ""
        for ch in inside.rsplit("}", 1)[0] + ",":
            depth += (ch == "{") - (ch == "}")
            if ch == "," and not depth:
                if part.strip():
                    yield from _rust_paths(before.strip() + part.strip())
                part = ""
            else:
                part += ch
        return
    path, _, alias = tree.partition(" as ")
    segments = [s for s in path.strip().split("::") if s and s != "*"]
    if segments and segments[-1] == "self" and len(segments) > 1:
        segments.pop()
    if segments:
        yield "::".join(segments), alias.strip() or segments[-1]


def _manifest(path: str, text: str) -> Iterator[str]:
    """Names of what a manifest depends on."""
    base = path.rsplit("/", 1)[-1]
    if base == "package.json":
        try:
            found = json.loads(text)
        except ValueError:
            return
        for part in ("dependencies", "devDependencies", "peerDependencies"):
            if isinstance(found, dict) and isinstance(found.get(part), dict):
                yield from found[part]
    elif re.fullmatch(r"requirements.*\.txt", base):
        yield from re.findall(r"^\s*([A-Za-z0-9][\w.\-]*)", text, re.M)
    elif base == "go.mod":
        yield from re.findall(r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+v\S+", text, re.M)
    elif base in ("Cargo.toml", "pubspec.yaml", "pyproject.toml"):
        inside = False
        for line in text.split("\n"):
            if m := re.match(r"\[(.+?)\]|(\w[\w_]*):\s*$", line):
                inside = bool(re.search(r"(?i)dependencies", m.group(1) or m.group(2)))
            elif inside and (m := re.match(r"\s*([\w.\-]+)\s*[:=]", line)):
                yield m.group(1)
            elif base == "pyproject.toml" and (m := re.match(r"\s*[\"']([A-Za-z0-9][\w.\-]*)[^\"']*[\"']\s*,?\s*$", line)):
                yield m.group(1)


def project_name(path: str, text: str) -> str | None:
    """What a go.mod or pubspec.yaml calls its project."""
    base = path.rsplit("/", 1)[-1]
    pattern = {"go.mod": r"^module\s+(\S+)", "pubspec.yaml": r"^name:\s*(\S+)"}.get(base)
    m = re.search(pattern, text, re.M) if pattern else None
    return m.group(1) if m else None


def imports_of(path: str, lang: str, text: str) -> list[dict]:
    found: list[tuple[int, str, str, list]] = []
    base = path.rsplit("/", 1)[-1]
    if base in ("package.json", "go.mod", "Cargo.toml", "pubspec.yaml", "pyproject.toml") or re.fullmatch(r"requirements.*\.txt", base):
        found += [(0, name, "dep", []) for name in dict.fromkeys(_manifest(path, text))]
    elif lang in ("javascript", "typescript", "vue", "svelte"):
        found += [(m.start("raw"), m["raw"], "js", _js_names(m["head"] or "") if m["head"] else []) for m in _JS.finditer(text)]
    elif lang == "go":
        for m in _GO.finditer(text):
            for n in re.finditer(r'(?:([\w.]+)\s+)?"([^"\n]+)"', m["many"] or m["one"]):
                found.append((m.start() + n.start(), n[2], "go", [(MODULE, n[1] or n[2].rsplit("/", 1)[-1])]))
    elif lang == "rust":
        found += [(m.start(1), m[1], "rust-mod", [(MODULE, m[1])]) for m in _RUST_MOD.finditer(text)]
        found += [(m.start(1), p, "rust", [(p.rsplit("::", 1)[-1], alias)]) for m in _RUST_USE.finditer(text) for p, alias in _rust_paths(m[1])]
    elif lang == "ruby":
        found += [(m.start(2), m[2], "ruby-rel" if m[1] else "ruby", []) for m in _RUBY.finditer(text)]
    elif lang == "php":
        found += [(m.start(1), m[1], "php", [(m[1].rsplit("\\", 1)[-1], m[2] or m[1].rsplit("\\", 1)[-1])]) for m in _PHP_USE.finditer(text)]
        found += [(m.start(1), m[1], "path", []) for m in _PHP_FILE.finditer(text)]
    elif lang == "markdown":
        found += [(m.start(1), m[1], "path", []) for m in _LINK.finditer(text)]
    elif lang in _PLAIN:
        rule, pattern = _PLAIN[lang]
        for m in pattern.finditer(text):
            last = m[1].rsplit(".", 1)[-1]
            found.append((m.start(1), m[1], rule, [(last, last)] if rule == "java" else []))
    return [{"path": path, "raw": raw, "line": text.count("\n", 0, at) + 1, "rule": rule, "names": [{"name": a, "alias": b} for a, b in names]} for at, raw, rule, names in sorted(found, key=lambda x: x[0])]


def source_imports(files: DataFrame) -> DataFrame:
    """Imports of files (path, lang, text)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, lang, t in zip(batch["path"], batch["lang"], batch["text"], strict=True) for r in imports_of(p, lang or "", t or "")]
            yield pd.DataFrame(rows, columns=["path", "raw", "line", "rule", "names"])

    return files.select("path", "lang", "text").mapInPandas(run, IMPORTS)


def project_names(files: DataFrame) -> DataFrame:
    """(path, name) of the manifests that name their project."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["name"] = [project_name(p, t or "") for p, t in zip(batch["path"], batch["text"], strict=True)]
            yield batch[["path", "name"]]

    return files.where(paths.base(F.col("path")).isin("go.mod", "pubspec.yaml")).select("path", "text").mapInPandas(run, "path string, name string").where("name is not null")


# ----------------------------------------------------------------- resolving
def normal(path: Column) -> Column:
    """A path without empty, '.' and '..' segments; what leads above the top keeps its '..'."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _each(base: Column, endings: list[str]) -> Column:
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def _js(base: Column) -> Column:
    stem = F.regexp_replace(base, JS_OUTPUT, "")
    written = F.when(base.rlike(JS_OUTPUT), _each(stem, JS_INPUT)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), _each(base, JS_ENDINGS), _each(F.concat(base, F.lit("/index")), JS_ENDINGS), written)


def _exact(raw: Column, here: Column, rule: Column, path: Column) -> Column:
    """The paths that an import may mean, in order."""
    inside = normal(F.concat_ws("/", here, raw))
    rest = F.substring(raw, 3, 1 << 20)
    js = (
        F.when(raw.startswith("node:") | raw.isin(NODE_BUILTINS), F.array())
        .when(raw.startswith("."), _js(inside))
        .when(raw.rlike("^[@~#]/"), F.flatten(F.array(*[_js(normal(F.concat(F.lit(b), rest))) for b in ("src/", "app/", "")])))
        .when(F.contains(raw, F.lit("/")) & ~raw.rlike("^[@/]"), F.concat(_js(normal(raw)), _js(normal(F.concat(F.lit("src/"), raw)))))
        .otherwise(F.array())
    )
    stem = F.regexp_replace(paths.base(path), r"\.[^.]*$", "")
    beside = F.array(join_path(here, F.concat(raw, F.lit(".rs"))), join_path(here, raw, F.lit("mod.rs")))
    below = F.array(join_path(here, stem, F.concat(raw, F.lit(".rs"))), join_path(here, stem, raw, F.lit("mod.rs")))
    rust = F.when(stem.isin("mod", "lib", "main"), beside).otherwise(F.concat(below, beside))
    none = F.array().cast("array<string>")
    return (
        F.when(rule == "js", js)
        .when(rule == "rust-mod", rust)
        .when(rule.isin("c", "bb"), F.array(inside, normal(raw)))
        .when(rule.isin("ruby-rel", "path"), F.concat(_each(inside, PATH_ENDINGS), _each(normal(raw), PATH_ENDINGS)))
        .when((rule == "dart") & ~raw.rlike("^(dart|package):"), F.array(inside))
        .otherwise(none)
        .cast("array<string>")
    )


def _endings(raw: Column, rule: Column) -> Column:
    """The endings of paths without extension that an import may mean, in order, each with what the extension must match."""

    def prefixes(parts: Column, also: tuple[str, ...] = ("",)) -> Column:
        each = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        return F.when(F.size(parts) > 0, F.flatten(F.transform(each, lambda p: F.array(*[F.concat(p, F.lit(a)) for a in also])))).otherwise(F.array().cast("array<string>"))

    def kind(names: Column, extension: Column) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("ending"), extension.alias("extension")))

    segments = F.filter(F.split(raw, "::"), lambda s: s != "")
    local = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    rust = F.when(F.get(segments, 0).isin(RUST_LOCAL), prefixes(local, ("", "/mod"))).otherwise(F.array().cast("array<string>"))
    ext = F.regexp_extract(raw, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(raw, r"\.[^./]*$", "")
    php = F.array(F.translate(raw, "\\", "/"), F.element_at(F.split(raw, r"\\"), -1))
    any_ = F.lit("")
    return (
        F.when(rule == "rust", kind(rust, any_))
        .when(rule.isin("java", "csharp"), kind(prefixes(F.split(F.translate(raw, ".", "/"), "/")), F.lit("jvm")))
        .when(rule.isin("c", "bb"), kind(F.array(stem), ext))
        .when(rule == "ruby", kind(F.array(raw), any_))
        .when(rule == "php", kind(php, any_))
        .otherwise(kind(F.array().cast("array<string>"), any_))
    )


JVM = [".java", ".kt", ".scala", ".cs"]


def nearest(asked: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Of the files with an ending (key, path, ending, extension) the one that shares most leading folders with ``path``: (key, found).

    Every file stands below each of its folders once for each ending, so the join is on
    (ending, folder, extension) and a common ending meets one row a folder.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    own = files.select("path").distinct().select("path", ext.alias("_ext"), F.explode(endings).alias("ending")).select("path", "ending", F.explode(F.array_distinct(F.array(F.lit(""), "_ext", F.when(F.col("_ext").isin(JVM), F.lit("jvm")).otherwise("")))).alias("extension"))
    above = own.select("ending", "extension", "path", F.explode(_folders(F.col("path"))).alias("dir"))
    # the two smallest, as one may be the asking file
    two = _two_least(above)
    want = asked.select(*dict.fromkeys([*key, "path"]), "ending", "extension", F.explode(_folders(F.col("path"))).alias("dir"))
    hit = want.join(two, ["ending", "extension", "dir"]).withColumn("found", F.when(F.col("first") == F.col("path"), F.col("second")).otherwise(F.col("first"))).where("found is not null")
    return hit.groupBy(*key).agg(F.max_by("found", F.length("dir")).alias("found"))


def _two_least(above: DataFrame) -> DataFrame:
    by = ["ending", "extension", "dir"]
    first = above.groupBy(*by).agg(F.min("path").alias("first"))
    rest = above.join(first, by).where("path > first").groupBy(*by).agg(F.min("path").alias("second"))
    return first.join(rest, by, "left")


def _folders(path: Column) -> Column:
    """The folders above a path, the top (empty) among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve(imports: DataFrame, files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(path, line, raw, rule, names, how, target): how is file, dir (a Go folder), package or none.

    files: path; projects: path of a manifest, name (``project_names``).
    """
    rows = imports.select("path", "line", "raw", "rule", "names").dropDuplicates(["path", "line", "raw", "rule"])
    key = ["path", "line", "raw", "rule"]
    here = folder(F.col("path"))
    asked = rows.select(*key, here.alias("_here"))
    known = files.select(F.col("path").alias("found")).distinct()
    exact = asked.select(*key, F.posexplode(_exact(F.col("raw"), F.col("_here"), F.col("rule"), F.col("path"))).alias("_pos", "found"))
    if projects is not None:
        dart = projects.where(paths.base(F.col("path")) == "pubspec.yaml").groupBy("name").agg(F.min(folder(F.col("path"))).alias("_dir"))
        inner = asked.where((F.col("rule") == "dart") & F.col("raw").startswith("package:")).withColumn("name", F.regexp_extract("raw", "^package:([^/]*)", 1))
        exact = exact.unionByName(inner.join(dart, "name").select(*key, F.lit(0).alias("_pos"), normal(F.concat_ws("/", "_dir", F.lit("lib"), F.regexp_replace("raw", "^package:[^/]*/?", ""))).alias("found")))
    first = exact.join(known, "found", "left_semi").groupBy(*key).agg(F.min_by("found", "_pos").alias("by_path"))
    wanted = asked.select(*key, F.posexplode(_endings(F.col("raw"), F.col("rule"))).alias("_pos", "_e")).select(*key, "_pos", "_e.ending", "_e.extension")
    by_end = nearest(wanted, files, [*key, "_pos"]).groupBy(*key).agg(F.min_by("found", "_pos").alias("by_end"))
    out = rows.join(first, key, "left").join(by_end, key, "left")
    raw, rule = F.col("raw"), F.col("rule")
    target = F.coalesce("by_path", "by_end")
    head = F.split(raw, "/")[0]
    none = F.lit(None).cast("string")
    package = (
        F.when(rule == "dep", raw)
        .when(rule == "js", F.when(raw.rlike(r"^([.~#/]|@/|node:)") | raw.isin(NODE_BUILTINS) | head.isin(NODE_BUILTINS), none).when(raw.startswith("@"), F.array_join(F.slice(F.split(raw, "/"), 1, 2), "/")).otherwise(head))
        .when(rule == "rust", F.when(F.split(raw, "::")[0].isin(RUST_BUILTINS + RUST_LOCAL), none).otherwise(F.split(raw, "::")[0]))
        .when(rule.isin("java", "csharp"), F.when(raw.rlike(JVM_BUILTINS), none).otherwise(F.array_join(F.slice(F.split(raw, r"\."), 1, 2), ".")))
        .when(rule == "ruby", head)
        .when(rule == "dart", F.when(raw.startswith("package:"), F.regexp_extract(raw, "^package:([^/]*)", 1)))
        .when(rule == "swift", F.when(~raw.isin(SWIFT_BUILTINS), raw))
        .when(rule == "go", F.when(F.contains(head, F.lit(".")), F.array_join(F.slice(F.split(raw, "/"), 1, 3), "/")))
    )
    if projects is not None:
        # the module of a repository: the top go.mod, else the first
        module = projects.where(paths.base(F.col("path")) == "go.mod").agg(F.min_by("name", F.struct(F.col("path") != "go.mod", "path")).alias("_module"))
        dirs = files.select(F.explode(_folders(F.col("path"))).alias("_dir")).distinct().withColumn("_is_dir", F.lit(True))
        out = out.crossJoin(F.broadcast(module))  # one row
        local = (rule == "go") & ((raw == F.col("_module")) | raw.startswith(F.concat(F.col("_module"), F.lit("/"))))
        out = out.withColumn("_go", F.when(local, F.regexp_replace(F.substr(raw, F.length("_module") + 1), "^/+", ""))).join(dirs, F.col("_go") == F.col("_dir"), "left")
        dart_local = projects.where(paths.base(F.col("path")) == "pubspec.yaml").select(F.concat(F.lit("package:"), "name").alias("_mine")).distinct()
        out = out.join(dart_local, F.regexp_extract(raw, "^(package:[^/]*)", 1) == F.col("_mine"), "left")
        package = F.when(F.col("_go").isNotNull() | F.col("_mine").isNotNull(), none).otherwise(package)
    else:
        out = out.withColumns({"_go": none, "_is_dir": F.lit(None).cast("boolean")})
    how = F.when(target.isNotNull(), "file").when(F.col("_is_dir"), "dir").when(package.isNotNull(), "package").otherwise("none")
    return out.select(*key, "names", how.alias("how"), F.coalesce(target, F.when(F.col("_is_dir"), F.col("_go")), package).alias("target"))
