"""Path predicates (P8-P10, F25) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the languages they mean.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "mts": "typescript", "cts": "typescript", "vue": "javascript", "svelte": "javascript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "rb": "ruby", "php": "php", "dart": "dart",
    "swift": "swift", "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "markdown": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "sql": "sql", "html": "html", "css": "css", "scss": "css", "xml": "xml", "gradle": "gradle", "bb": "bitbake", "bbappend": "bitbake", "bbclass": "bitbake",
    "inc": "bitbake", "conf": "bitbake", "dts": "devicetree", "dtsi": "devicetree",
}
MANIFESTS = ["package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pubspec.yaml", "composer.json"]


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test(path: Column) -> Column:
    """P10."""
    # Folders and names of tests.
    p = F.lower(path)
    return p.rlike(r"(^|/)(tests?|__tests__|spec|specs|e2e|testing)(/|$)") | base(p).rlike(r"^(test_.*|.*_test\.\w+|.*\.test\.\w+|.*\.spec\.\w+|.*_spec\.\w+|.*tests?\.\w+)$")


def is_secret(path: Column) -> Column:
    """P9."""
    # Folders and names of secrets.
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return p.rlike(r"(^|/)(secrets|\.env)/") | base(p).rlike(r"^\.env|^id_rsa|^id_ed25519|credentials|\.(pem|key|p12|pfx|keystore|jks)$")


def language(path: Column) -> Column:
    """F25."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = base(path)
    return F.when(name.isin(MANIFESTS) | name.rlike(r"^requirements.*\.txt$"), "manifest").otherwise(F.coalesce(table[F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))], F.lit("")))


def ancestors(path: Column) -> Column:
    """All directory prefixes, from the root's child down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
