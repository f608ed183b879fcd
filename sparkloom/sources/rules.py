"""Engine options, ignore rules and manifests."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


@dataclass(frozen=True)
class Options:
    """Defaults, overridden layer by layer; unknown keys and wrong types are left out."""

    turn_retention_days: int = 0
    redact_patterns: tuple[str, ...] = ()
    fold: bool = True
    fold_chars: int = 12000
    fold_head: int = 40
    fold_tail: int = 20
    fold_tools: tuple[str, ...] = ("Bash",)

    def over(self, *layers: dict) -> Options:
        out = self
        for layer in layers:
            for f in fields(self):
                if f.name in layer:
                    old, new = getattr(out, f.name), layer[f.name]
                    new = tuple(new) if isinstance(old, tuple) and isinstance(new, list) else new
                    if type(new) is type(old):
                        out = replace(out, **{f.name: new})
        return out


def glob_pattern(glob: str) -> str:
    """A shell glob as a regular expression for the whole text."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2)
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return f"^(?s:{out})$"


def ignored(path: Column, globs: list[str]) -> Column:
    """A glob matches the whole path, its last part or any of its folders."""
    out = F.lit(False)
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    for g in (x.strip() for x in globs):
        if g and not g.startswith("#"):
            p = glob_pattern(g.rstrip("/"))
            out = out | path.rlike(p) | paths.base(path).rlike(p) | F.exists(folders, _matches(p))
    return out


def _matches(pattern: str):
    return lambda s: s.rlike(pattern)


def dependencies(name: str, text: str, limit: int = 150) -> list[str]:
    """What a manifest depends on, in order, each once."""
    import json
    import re

    found: list[str] = []
    try:
        if name in ("package.json", "composer.json"):
            data = json.loads(text)
            for key in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev"):
                found += list(data.get(key) or {})
        elif name in ("pyproject.toml", "Cargo.toml"):
            data = tomllib.loads(text)
            project = data.get("project", {})
            found += [re.split(r"[\s<>=!~;\[(@]", x, maxsplit=1)[0] for x in project.get("dependencies", [])]
            found += [x for x in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if x != "python"]
            found += [x for key in ("dependencies", "dev-dependencies") for x in data.get(key, {})]
        elif name.startswith("requirements"):
            found += [m[1] for x in text.splitlines() if (m := re.match(r"\s*([A-Za-z0-9][\w.\-]*)", x))]
        elif name == "go.mod":
            found += re.findall(r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+v\S+", text, re.M)
        elif name == "pubspec.yaml":
            for block in re.findall(r"^(?:dev_)?dependencies:\s*\n((?:[ \t]+.*\n?|\s*\n)*)", text, re.M):
                found += re.findall(r"^  ([A-Za-z_]\w*):", block, re.M)
    except (ValueError, AttributeError, TypeError):
        return []
    return list(dict.fromkeys(x for x in found if x))[:limit]


def manifests(files: DataFrame) -> DataFrame:
    """(path, dependency, ord) of the manifests among files (path, text)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, d, k) for p, t in zip(b["path"], b["text"], strict=True) for k, d in enumerate(dependencies(p.rsplit("/", 1)[-1], t or ""))]
            yield pd.DataFrame(rows, columns=["path", "dependency", "ord"]).astype({"ord": "int64"})

    return files.where(paths.language(F.col("path")) == "manifest").select("path", "text").mapInPandas(run, "path string, dependency string, ord long")
