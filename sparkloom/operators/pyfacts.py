"""Facts of Python sources by the standard parser (E1, W6): what a file declares, imports, calls and names.

A file is read alone; a task holds one batch of files. Declarations are those of
the module and of its classes; what a function does, with all that is nested in
it, is done by that function. Of declarations with one qualified name the later
ones get ``#2``, ``#3`` and so on.
"""

from __future__ import annotations

import ast
import hashlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

SYMBOL = "name:string,qualname:string,kind:string,line:int,end_line:int,sig:string,doc:string,hash:string,parent:string,decorators:array<string>"
FACTS = (
    f"path string, lang string, doc string, loc int, entry boolean, symbols array<struct<{SYMBOL}>>, "
    "imports array<struct<raw:string,level:int,line:int,rule:string,names:array<struct<name:string,alias:string>>>>, "
    "calls array<struct<owner:string,raw:string>>, bases array<struct<qualname:string,base:string>>, refs array<string>, error string"
)
NAMES = [c.split()[0] for c in "path lang doc loc entry symbols imports calls bases refs error".split()]
# Bounds on what is kept of one file.
CONSTANTS, REFERENCES, SIG, CONST_SIG, DOC, DECORATOR = 40, 1500, 160, 120, 160, 60
#: What an imported name stands for when it is the module itself.
MODULE = "*mod"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)


def short(text: str, limit: int) -> str:
    """One line of at most ``limit`` characters, cut at a late blank (as the column function ``truncate``)."""
    text = " ".join(text.split())
    if len(text) <= limit:
        return text
    head = text[: limit - 1]
    blank = head.rfind(" ")
    return (head[:blank] if blank >= 0.6 * limit else head).rstrip(" ,;:-") + "…"


def body_hash(lines: list[str], line: int, end: int) -> str:
    return hashlib.sha1("\n".join(lines[line - 1 : end]).encode("utf-8", "replace")).hexdigest()[:16]


def numbered(symbols: list[dict]) -> list[dict]:
    """Repeated qualified names by their order."""
    seen: Counter = Counter()
    for s in symbols:
        seen[s["qualname"]] += 1
        if seen[s["qualname"]] > 1:
            s["qualname"] += f"#{seen[s['qualname']]}"
    return symbols


def dotted(node: ast.AST) -> str | None:
    """a.b.c if that is all it is."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def called(node: ast.Call) -> str | None:
    """The dotted name of what is called; a method of something unnamed begins with a dot."""
    return dotted(node.func) or (f".{node.func.attr}" if isinstance(node.func, ast.Attribute) else None)


class Reader:
    """Collects the facts of one module."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines()
        self.symbols: list[dict] = []
        self.calls: dict[tuple[str, str], None] = {}
        self.bases: list[dict] = []
        self.entry = False
        self.tree = ast.parse(text)

    def add(self, node: ast.AST, name: str, kind: str, sig: str, parent: str | None = None, limit: int = SIG) -> str:
        qualname = f"{parent}.{name}" if parent else name
        scope = isinstance(node, _SCOPES)
        doc = (ast.get_docstring(node) or "") if scope else ""
        self.symbols.append({
            "name": name, "qualname": qualname, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "sig": short(sig, limit), "doc": short(doc.split("\n")[0], DOC),
            "hash": body_hash(self.lines, node.lineno, node.end_lineno), "parent": parent, "decorators": [short(ast.unparse(d), DECORATOR) for d in node.decorator_list] if scope else [],
        })
        return qualname

    def call_all(self, owner: str, nodes: Iterator[ast.AST]) -> None:
        for n in nodes:
            if isinstance(n, ast.Call) and (name := called(n)):
                self.calls[owner, name] = None

    def declare(self, node: ast.AST, parent: str | None) -> None:
        """A function or class; the declarations in a class follow."""
        if isinstance(node, _FUNCTIONS):
            word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            own = self.add(node, node.name, "method" if parent else "function", f"{word} {node.name}({ast.unparse(node.args)}){result}", parent)
            self.call_all(own, ast.walk(node))
            return
        heirs = [b for b in map(dotted, node.bases) if b]
        own = self.add(node, node.name, "class", f"class {node.name}" + (f"({', '.join(heirs)})" if heirs else ""), parent)
        self.bases += [{"qualname": own, "base": b} for b in heirs]
        for child in node.body:
            if isinstance(child, _SCOPES):
                self.declare(child, own)

    def statement(self, node: ast.stmt) -> None:
        """A statement of the module that declares no function or class: constants, calls, the entry."""
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name) and len(t.id) > 1 and t.id.isupper() and sum(s["kind"] == "const" for s in self.symbols) < CONSTANTS:
                self.add(node, t.id, "const", self.lines[node.lineno - 1].strip(), limit=CONST_SIG)
        if isinstance(node, ast.If):
            test = ast.unparse(node.test)
            self.entry |= "__name__" in test and "__main__" in test

        def outside(n: ast.AST) -> Iterator[ast.AST]:
            yield n
            for child in ast.iter_child_nodes(n):
                if not isinstance(child, _SCOPES):
                    yield from outside(child)

        self.call_all("", outside(node))

    def facts(self, path: str) -> tuple:
        for node in self.tree.body:
            if isinstance(node, _SCOPES):
                self.declare(node, None)
            else:
                self.statement(node)
        imports, names = [], {}
        for n in ast.walk(self.tree):
            if isinstance(n, ast.Import):
                imports += [{"raw": a.name, "level": 0, "line": n.lineno, "rule": "python", "names": [{"name": MODULE, "alias": a.asname or a.name.partition(".")[0]}]} for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                imports.append({"raw": n.module or "", "level": n.level, "line": n.lineno, "rule": "python", "names": [{"name": a.name, "alias": a.asname or a.name} for a in n.names]})
            elif isinstance(n, (ast.Name, ast.Attribute)):
                names[n.id if isinstance(n, ast.Name) else n.attr] = None
        doc = ast.get_docstring(self.tree) or ""
        refs = [r for r in names if len(r) > 2][:REFERENCES]
        return path, "python", short(doc.split("\n")[0], DOC), len(self.lines), self.entry, numbered(self.symbols), imports, [{"owner": o, "raw": r} for o, r in self.calls], self.bases, refs, None


def one(path: str, text: str | None) -> tuple:
    """The facts of a file; a broken one has its error only."""
    try:
        return Reader(text or "").facts(path)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return path, "python", "", len((text or "").splitlines()), False, [], [], [], [], [], f"{type(e).__name__}: {e}"


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of (path, text); a null text is an empty file."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, t) for p, t in zip(batch["path"], batch["text"], strict=True)], columns=NAMES)

    return files.select("path", "text").mapInPandas(run, FACTS)
