"""Symbols of source files in languages without a parser here.

Comments and the insides of strings are blanked, then each line is read as words:
modifiers are skipped, a word that declares something gives the kind, and what
follows it the name, the owner and the base. Languages whose functions have no
such word take a type, a name and a bracket for one. What a declaration belongs to
follows from braces, indentation or, for formats without scopes, from nothing. A
file is read alone, so a task holds one batch of files; files that are too long
are cut by the reader's size limit, not here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

FACTS = "path string, lang string, symbols array<struct<name:string,qualname:string,kind:string,line:int,end_line:int,sig:string>>, bases array<struct<qualname:string,base:string>>, calls array<struct<owner:string,raw:string>>, entry boolean, loc int"
HOLDERS = {"class", "interface", "struct", "trait", "object", "enum", "impl", "module", "extension", "protocol", "mixin", "record"}
CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)\s*\(")
# Words before a bracket that call nothing, or begin a statement.
NO_CALL = set("if for while switch catch return function func fn def match elif else do sizeof typeof await new throw case when until unless and or not in is with assert".split())
STATEMENT = NO_CALL | {"typedef", "using", "import", "package", "delete", "goto", "break", "continue", "yield", "try", "finally"}
_WORD = re.compile(r"[A-Za-z_$@][\w$]*|=>|->|::|\S")
_DASHED = re.compile(r"[A-Za-z_$@&/][\w$.,:+@-]*|\S")
#: What may stand between a name and its base.
BASE_WORDS = {"extends", "implements", ":", "<", "with", "(", "public", "private", "protected", "virtual"}


@dataclass
class Language:
    """How a language declares: ``declares`` has the kind for each word that does, ``skips`` the words before it."""

    declares: dict[str, str]
    skips: set[str] = field(default_factory=set)
    typed: bool = False  # a type, a name and a bracket are a function
    bases: set[str] = field(default_factory=set)  # what leads to a base
    scope: str = "brace"
    line_comment: str = "//"
    block_comment: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    entry: str | None = None
    words: re.Pattern = _WORD


def _of(text: str, **other: str) -> dict[str, str]:
    return {w: w for w in text.split()} | other


_ACCESS = set("public private protected internal static final abstract sealed partial readonly async override virtual synchronized default native extern unsafe new open data inline value suspend operator infix companion implicit lazy case annotation fileprivate mutating indirect".split())
_C_STYLE = {"template", "static", "inline", "extern", "typedef", "virtual", "constexpr", "friend"}
_COLON = {":", "public", "private", "protected", "virtual"}
_HEIRS = {"extends", "implements", ":", "with"}
# The words of each language.
LANGUAGES: dict[str, Language] = {
    "javascript": Language(_of("class interface enum type function", const="value", let="value", var="value"), {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "get", "set", "*"}, bases=_HEIRS, quotes="\"'`"),
    "go": Language({"func": "function", "type": "type"}, quotes="\"`", entry=r"^func\s+main\s*\("),
    "rust": Language({"fn": "function", "mod": "module"} | _of("struct enum trait type impl"), {"pub", "async", "const", "unsafe", "extern", "default"}, quotes='"', entry=r"\bfn\s+main\s*\("),
    "java": Language(_of("class interface enum record"), _ACCESS, True, _HEIRS, entry=r"\bstatic\s+void\s+main\s*\("),
    "csharp": Language(_of("class interface enum record struct"), _ACCESS, True, _HEIRS, entry=r"\bstatic\s+.*\bMain\s*\("),
    "kotlin": Language(_of("class interface object", fun="function"), _ACCESS | {"enum"}, bases=_HEIRS, entry=r"\bfun\s+main\s*\("),
    "scala": Language({"def": "function"} | _of("class trait object"), _ACCESS, bases=_HEIRS, entry=r"\bdef\s+main\s*\(|\bextends\s+App\b"),
    "c": Language(_of("struct enum"), _C_STYLE, True, entry=r"\bint\s+main\s*\("),
    "cpp": Language(_of("class struct enum", namespace="module"), _C_STYLE, True, _COLON, entry=r"\bint\s+main\s*\("),
    "php": Language(_of("class interface trait enum function"), {"abstract", "final", "readonly", "public", "private", "protected", "static", "&"}, bases=_HEIRS),
    "dart": Language(_of("class mixin enum extension"), {"abstract", "final", "sealed", "base", "static"}, True, _HEIRS, entry=r"\bmain\s*\("),
    "swift": Language(_of("class struct enum protocol extension", func="function"), _ACCESS, bases=_HEIRS, entry=r"^\s*@main\b"),
    "ruby": Language(_of("class module", **{"def": "function"}), bases={"<"}, scope="indent", line_comment="#", block_comment=None),
    "python": Language({"class": "class", "def": "function"}, {"async"}, bases={"("}, scope="indent", line_comment="#", block_comment=None, entry=r"^if\s+__name__\s*=="),
    "shell": Language({"function": "function"}, scope="none", line_comment="#", block_comment=None, entry=r"^#!", words=_DASHED),
    "sql": Language(_of("table view index function procedure trigger type"), set("create or replace temp temporary unique materialized".split()), scope="none", line_comment="--", words=re.compile(r"[A-Za-z_][\w.]*|\S")),
    "bitbake": Language({"def": "function"}, {"python", "fakeroot"}, scope="none", line_comment="#", block_comment=None, words=_DASHED),
    "devicetree": Language({}, scope="none", words=_DASHED),
}
LANGUAGES["typescript"] = LANGUAGES["javascript"]
#: Formats that declare nothing but are files of a project.
PLAIN = ["json", "yaml", "toml", "html", "css", "xml", "gradle", "manifest"]


class Found(NamedTuple):
    kind: str
    name: str
    base: str | None = None
    owner: str | None = None


def _is_name(word: str) -> bool:
    return bool(word) and (word[0].isalpha() or word[0] in "_$") and word not in NO_CALL


def _past(t: list[str], i: int, pairs: dict[str, str]) -> int:
    """The place after a bracketed part that begins at ``i``, if one does."""
    if i >= len(t) or t[i] not in pairs:
        return i
    depth, closing = 0, pairs[t[i]]
    for k in range(i, len(t)):
        depth += (t[k] == t[i]) - (t[k] == closing)
        if not depth:
            return k + 1
    return len(t)


def _path(t: list[str], i: int) -> tuple[list[str], int]:
    """Names joined by dots or colons from ``i`` on, and the place after them."""
    out = [t[i]] if i < len(t) and _is_name(t[i]) else []
    i += len(out)
    while out and i + 1 < len(t) and t[i] in (".", "::") and _is_name(t[i + 1]):
        out.append(t[i + 1])
        i += 2
    return out, i


GENERIC, ROUND = {"<": ">", "[": "]"}, {"(": ")"}


def _start(t: list[str], lang: Language) -> int:
    """The place of the first word that is no modifier, annotation or parameter list of one."""
    i = 0
    while i < len(t) and (t[i].lower() in lang.skips or t[i][0] == "@") and not (t[i] == "const" and "const" in lang.declares):
        if i + 1 < len(t) and t[i] in ("enum", "value", "open", "data") and t[i] in lang.declares and _is_name(t[i + 1]) and t[i + 1] not in lang.declares:
            break
        i = _past(t, _past(t, i + 1, ROUND), {"<": ">"} if t[i] == "template" else {})
    return i


def _base(t: list[str], i: int, lang: Language) -> str | None:
    """The first base after a name."""
    if "(" not in lang.bases:
        i = _past(t, i, ROUND)
    if "<" not in lang.bases:
        i = _past(t, i, GENERIC)
    seen = False
    while i < len(t) and (t[i] in lang.bases or t[i] == "final"):
        seen |= t[i] in lang.bases
        i += 1
    path, _ = _path(t, i) if seen else ([], i)
    return ".".join(path) or None


def declaration(line: str, lang: Language, name: str, in_holder: bool) -> Found | None:
    """What a line (without comments and strings) declares, if anything."""
    t = lang.words.findall(line)
    if not t:
        return None
    if name == "devicetree":
        node = [x for x in t if x != "{"]
        return Found("node", node[-1]) if t[-1] == "{" and node else None
    if name in ("shell", "bitbake") and t[-1:] != ["="]:
        i = _start(t, lang)
        if t[i + 1 : i + 3] == ["(", ")"] and t[i] not in NO_CALL:
            return Found("function", t[i])
    if name == "sql" and t[0].lower() != "create":
        return None
    i = _start(t, lang)
    word = (t[i].lower() if name == "sql" else t[i]) if i < len(t) else ""
    kind = lang.declares.get(word)
    if kind is None:
        return _unnamed(t, i, lang, in_holder)
    i += 1
    if name == "sql" and [x.lower() for x in t[i : i + 3]] == ["if", "not", "exists"]:
        i += 3
    if name == "sql":
        return Found(kind, t[i]) if i < len(t) and t[i][0].isalpha() else None
    if word == "enum" and t[i : i + 1] in (["class"], ["struct"]):
        i += 1
    owner = None
    if name == "go" and kind == "function" and t[i : i + 1] == ["("]:
        end = _past(t, i, ROUND)
        inside = [x for x in t[i:end] if _is_name(x)]
        owner = inside[1] if len(inside) > 1 and t[i + 1] == inside[0] else inside[0] if inside else None
        i = end
        kind = "method"
    if kind == "impl":
        i = _past(t, i, GENERIC)
        path, i = _path(t, i)
        i = _past(t, i, GENERIC)
        other, _ = _path(t, i + 1) if t[i : i + 1] == ["for"] else ([], i)
        return Found("impl", (other or path)[-1], ".".join(path) if other else None) if path else None
    if name == "kotlin":
        i = _past(t, i, GENERIC)
    while i < len(t) and t[i] in ("*", "&"):
        i += 1
    path, after = _path(t, i)
    if name == "ruby" and path[:1] == ["self"]:
        path = path[1:]
    if not path:
        return None
    own = path[-1]
    if kind == "value":
        rest = t[after:]
        at = rest.index("=") if "=" in rest else len(rest)
        value = [x for x in rest[at + 1 :] if x != "async"]
        return Found("function", own) if value[:1] == ["function"] or "=>" in value and (value[0] == "(" or value[1:2] == ["=>"]) else None
    if name == "ruby" and kind == "function" and after < len(t) and t[after] in ("?", "!", "=") and re.search(re.escape(own) + re.escape(t[after]), line):
        own += t[after]
    if name == "go" and kind == "type":
        shape = t[_past(t, after, GENERIC) : _past(t, after, GENERIC) + 1]
        return Found(shape[0] if shape in (["struct"], ["interface"]) else "type", own)
    if kind == "type" and "=" not in t or kind == "module" and name == "rust" and t[-1] != "{" or kind in ("class", "struct") and name in ("c", "cpp") and (t[-1] == ";" or "(" in t):
        return None
    if name == "dart" and kind == "extension" and "on" not in t:
        return None
    return Found(kind, own, _base(t, after, lang), owner)


def _unnamed(t: list[str], i: int, lang: Language, in_holder: bool) -> Found | None:
    """A function that no word declares: a type, a name and a bracket; in a class also a name and a bracket."""
    if "(" not in t or t[0] in STATEMENT:
        return None
    at = t.index("(", i) if "(" in t[i:] else 0
    name = t[at - 1] if at > i else ""
    if ">" in t[i:at] and not _is_name(name):  # type parameters after the name
        name = ""
    if not _is_name(name) or any(x in ("=", ".", "=>", "->") for x in t[i : at - 1] if x != "."):
        arrow = in_holder and not lang.typed and t[i + 1 : i + 2] == ["="] and "=>" in t and _is_name(t[i])
        return Found("method", t[i]) if arrow else None
    begins = t[-1] == "{"
    if "value" in lang.declares.values():
        return Found("method", name) if in_holder and begins and at == i + 1 else None
    if not lang.typed or ";" in t[at:]:
        return None
    before = t[i : at - 1]
    owner = None
    if before[-1:] == ["::"] and len(before) > 1:
        owner, before = before[-2], before[:-2]
    if not before:
        return Found("method", name) if in_holder and begins else None
    if before[-1] in (".", ",", "(", "=") or not any(_is_name(x) for x in before) or any(x in STATEMENT for x in before):
        return None
    return Found("function", name, None, owner)


class Scope(NamedTuple):
    level: int
    name: str
    kind: str
    row: int


def blanked(text: str, lang: Language) -> str:
    """The text with comments and the insides of strings replaced by blanks, line feeds kept."""
    begin, end = lang.block_comment or ("", "")
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else r'\n'}])*{q}" for q in lang.quotes)
    comments = [re.escape(lang.line_comment) + r"[^\n]*"] + ([re.escape(begin) + r".*?(?:" + re.escape(end) + r"|\Z)"] if begin else [])
    pattern = re.compile(f"(?P<s>{strings})|(?P<c>{'|'.join(comments)})", re.S)

    def blank(m: re.Match) -> str:
        t = m.group()
        return t[0] + re.sub(r"[^\n]", " ", t[1:-1]) + t[-1] if m.group("s") else re.sub(r"[^\n]", " ", t)

    return pattern.sub(blank, text)


def scan(text: str, lang: str) -> tuple[list[dict], list[dict], list[dict], bool]:
    """(symbols, bases, calls, entry) of one source."""
    if lang == "markdown":
        return sections(text), [], [], False
    spec = LANGUAGES.get(lang)
    if spec is None:
        return [], [], [], False
    symbols, bases, calls = [], [], set()
    stack: list[Scope] = []
    depth, raw = 0, text.split("\n")
    clean = blanked(text, spec).split("\n")

    def close(level: int, last: int) -> None:
        while stack and stack[-1].level >= level:
            top = stack.pop()
            if top.row >= 0:
                symbols[top.row]["end_line"] = max(symbols[top.row]["line"], last)

    for n, line in enumerate(clean, 1):
        if not line.strip():
            continue
        if spec.scope == "indent":
            depth = len(line) - len(line.lstrip())
            if lang == "ruby" and re.match(r"\s*end\b", line):
                close(depth, n)
            elif not re.match(r"\s*[)\]}]", line):
                close(depth, n - 1)
        opened = None
        if spec.scope == "brace" and stack and stack[-1].level == depth and not line.lstrip().startswith("{") and declaration(line, spec, lang, False):
            close(depth, n - 1)  # declared without a body
        holder = stack[-1] if stack and stack[-1].kind in HOLDERS else None
        inside = stack and stack[-1].kind not in HOLDERS and spec.scope == "brace"
        got = declaration(line, spec, lang, holder is not None)
        if got and not (inside and (got.kind == "method" or spec.typed and got.kind == "function")):
            outer = [s.name for s in stack] + ([got.owner] if got.owner else [])
            kind = "method" if got.kind == "function" and (holder or got.owner) else got.kind
            qualname = ".".join([*outer, got.name])
            if got.base:
                bases.append({"qualname": qualname, "base": got.base})
            row = -1
            if kind != "impl":
                row = len(symbols)
                symbols.append({"name": got.name, "qualname": qualname, "kind": kind, "line": n, "end_line": n, "sig": " ".join(raw[n - 1].split()).rstrip("{ ")[:160]})
            if spec.scope != "none":
                opened = Scope(depth, got.name, kind, row)
        owner = ".".join(s.name for s in stack)
        for c in CALL.finditer(line):
            name = re.sub(r"::|->", ".", c.group(1))
            if name.split(".")[-1] not in NO_CALL and not (opened and name == opened.name):
                calls.add((owner, name))
        if opened:
            stack.append(opened)
        if spec.scope == "brace":
            seen_open = False
            for ch in line:
                if ch == "{":
                    depth, seen_open = depth + 1, True
                elif ch == "}":
                    depth = max(0, depth - 1)
                    close(depth, n)
            if opened and not seen_open and stack and stack[-1] is opened and line.rstrip().endswith((";", ")")) and ";" in line:
                stack.pop()  # declared without a body
    close(0, len(raw))
    entry = bool(spec.entry and any(re.search(spec.entry, x) for x in (raw if lang in ("shell", "python") else clean)))
    return symbols, bases, [{"owner": o, "raw": r} for o, r in sorted(calls)], entry


def doc_above(lines: list[str], line: int) -> str:
    """the first words of the comment block that stands right above a line (from 1); annotations between are passed."""
    said: list[str] = []
    for above in reversed(lines[: line - 1]):
        t = above.strip()
        if t.startswith("@"):
            continue
        if not t.startswith(("//", "#", "*", "/*")) or t.startswith(("#include", "#!")):
            break
        said.append(t.lstrip("/#* ").rstrip("*/ "))
    return next((t for t in reversed(said) if t), "")


def sections(text: str) -> list[dict]:
    """E5: headings of a Markdown text with those above them, not inside fences."""
    out, above, fenced = [], [], False
    rows = text.split("\n")
    for n, line in enumerate(rows, 1):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if m:
            level = len(m[1])
            while above and above[-1][0] >= level:
                out[above.pop()[1]]["end_line"] = n - 1
            out.append({"name": m[2], "qualname": " > ".join([out[i]["name"] for _, i in above] + [m[2]]), "kind": "section", "line": n, "end_line": n, "sig": line.strip()[:160]})
            above.append((level, len(out) - 1))
    for _, i in above:
        out[i]["end_line"] = len(rows)
    return out


def source_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, lang, text); a null text is empty, an unknown language has no symbols."""
    import pandas as pd

    def one(path: str, lang: str, text: str | None) -> tuple:
        text = text or ""
        return path, lang, *scan(text, lang or ""), text.count("\n") + (1 if text and not text.endswith("\n") else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(*x) for x in zip(batch["path"], batch["lang"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "lang", "symbols", "bases", "calls", "entry", "loc"])

    return files.select("path", "lang", "text").mapInPandas(run, FACTS)
