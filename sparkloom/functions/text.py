"""Scalar text functions (F1-F20, P8-P18) as column expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = """
a an and are as at be been but by can could did do does for from had has have how i if in into is it its
just let me more my no not of on only or our out over so some than that the their them then there these
they this to too up us use used using was we were what when where which while who why will with would you
your also any all after before about should must need want get got make made new now via per yes""".split()
# Shapes of secrets.
SECRETS = [
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    r"\bAIza[0-9A-Za-z_\-]{35}\b",
]
# Words that make a log line salient.
SALIENT = r"(?i)\b(error|errors|fail|failed|failure|exception|traceback|warning|panic|fatal|segfault|assert(ion)?|denied|undefined|undeclared|not found)\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """one line of at most ``limit`` characters, cut at a late blank, with an ellipsis."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, limit - 1)
        blank = F.lit(limit - 1) - F.instr(F.reverse(head), " ")
        short = F.when((F.instr(head, " ") > 0) & (blank >= 0.6 * limit), F.substring(head, F.lit(1), blank)).otherwise(head)
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(short, r"[ ,;:\-]+$", ""), F.lit("…")))

    return let(squeeze(F.coalesce(text, F.lit(""))), cut)


def split_identifier(name: Column) -> Column:
    """lower-case words of an identifier."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def search_text(*parts: Column) -> Column:
    """the parts and the words of their compound identifiers."""
    words = F.flatten(F.transform(F.flatten(F.array(*[tokens(p) for p in parts])), lambda w: let(split_identifier(w), lambda s: F.when(F.size(s) > 1, s).otherwise(F.array().cast("array<string>")))))
    return F.concat_ws(" ", *parts, F.array_join(words, " "))


def terms(text: Column) -> Column:
    """the distinct significant words, and numbers of two digits or more."""
    stop = F.array(*map(F.lit, STOP_WORDS))

    def own(w: Column) -> Column:
        low = F.lower(w)
        number = w.rlike("^[0-9]+$")
        compound = w.rlike("_|[a-z0-9][A-Z]|[A-Z]{2}[a-z]")  # only these have words of their own
        word = ~number & (F.length(w) >= 3)
        subs = F.filter(split_identifier(w), lambda s: F.length(s) >= 3)
        nothing = F.array().cast("array<string>")
        return F.when(number, F.when(F.length(w) >= 2, F.array(w)).otherwise(nothing)).when(word & compound, F.when(F.array_contains(stop, low), nothing).otherwise(F.concat(F.array(low), subs))).when(word, F.array(low)).otherwise(nothing)

    return F.array_except(F.flatten(F.transform(F.array_distinct(tokens(text)), own)), stop)


def query_words(text: Column) -> Column:
    """sorted terms, or short words if there are none."""
    short = F.array_sort(F.array_distinct(F.transform(F.filter(tokens(text), lambda w: F.length(w) >= 2), F.lower)))
    return let(terms(text), lambda t: F.when(F.size(t) > 0, F.array_sort(t)).otherwise(short))


def derive_title(text: Column, limit: int = 80) -> Column:
    """the first line's first sentence if it fits, else the line cut to ``limit``."""
    line = F.trim(F.element_at(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n"), 1))
    sentence = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.when((F.length(sentence) > 0) & (F.length(sentence) <= limit), sentence).otherwise(truncate(line, limit))


def strip_private(text: Column) -> Column:
    """outermost <private> spans, counted by depth; an open one runs to the end."""
    parts = F.split(text, r"(?i)(?=</?private>)")  # every part but the first begins with a tag

    def step(acc: Column, part: Column) -> Column:
        opens, closes = F.lower(part).startswith("<private>"), F.lower(part).startswith("</private>")
        depth = F.when(opens, acc["depth"] + 1).when(closes & (acc["depth"] > 0), acc["depth"] - 1).otherwise(acc["depth"])
        rest = F.when(opens & (acc["depth"] == 0), F.lit("[private]")).when((acc["depth"] == 1) & closes, F.substring(part, F.lit(11), F.length(part))).when(acc["depth"] == 0, part).otherwise(F.lit(""))
        return F.struct(depth.alias("depth"), F.concat(acc["out"], rest).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda a: a["out"])


def redact(text: Column, extra: list[str] | None = None) -> Column:
    """private spans, built-in secret shapes, then the caller's patterns."""
    out = strip_private(text)
    for p in [*SECRETS, *(extra or [])]:
        out = F.regexp_replace(out, p, "[redacted]")
    return out


def valid_patterns(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(usable, rejected) user patterns."""
    import re

    good, bad = [], []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            bad.append(p)
    return good, bad


def ago(then: Column, now: Column) -> Column:
    """F14."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(then.isNull(), "never").when(s < 60, "just now").when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))).when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))


def est_tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 3.5) + 1).cast("long")


def lines(text: Column) -> Column:
    """split on line feeds only; one empty last line goes."""
    parts = F.split(text, "\n", -1)
    return F.when(text.endswith("\n"), F.slice(parts, F.lit(1), F.size(parts) - 1)).when(text == "", F.array().cast("array<string>")).otherwise(parts)


def cut_line(line: Column, limit: int = 300) -> Column:
    """F18."""
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit(" …[+"), (F.length(line) - limit).cast("string"), F.lit(" chars]"))).otherwise(line)


def is_salient(line: Column) -> Column:
    return F.substring(line, 1, 2000).rlike(SALIENT)


def key_of(kind: Column, text: Column) -> Column:
    return F.concat_ws("|", kind, F.lower(squeeze(text)))


def bar(value: Column, most: Column, width: int = 20) -> Column:
    """a bar of at least one block for what is not zero."""
    n = F.when(value > 0, F.greatest(F.lit(1), F.round(value * width / most).cast("int"))).otherwise(0)
    return F.expr("''") if width < 1 else F.repeat(F.lit("█"), n)


def id_text(kind: Column, number: Column) -> Column:
    """F8."""
    # The letter of each kind.
    prefix = F.create_map(*[F.lit(x) for kv in {"pin": "P", "decision": "D", "task": "T", "error": "E", "note": "N", "handoff": "H", "turn": "M", "fold": "F"}.items() for x in kv])
    return F.concat(prefix[kind], number.cast("string"))


def looks_done(text: Column) -> Column:
    """A word of completion, unless the text starts by asking to complete something."""
    # Words of completion, and how a request to complete something starts.
    words = r"(?i)\b(complete|completed|done|finished|shipped|resolved)\b"
    n = F.regexp_count(text, F.lit(words))
    asks = text.rlike(r"(?i)^\s*complete\s+(?![:\-–—])")
    return n - asks.cast("int") > 0


def is_snapshot(text: Column) -> Column:
    """A dated progress line rather than a rule."""
    # How progress lines start.
    return text.rlike(
        r"(?i)^\s*(checkpoint\b|phase\s*\d+\s*(done|complete|completed)\b|.{0,40}\b(live\s+)?progress\b|status\b|.{0,30}\bstatus\s+\d{4}-\d\d-\d\d|"
        r"verification at checkpoint|audit\s+\d{4}-\d\d-\d\d|(?-i:[A-Z0-9 _-]{3,40}\b(DONE|COMPLETE|COMPLETED|LIVE)\b[^:(]{0,20}[:(]))"
    )


def parse_ts(text: Column) -> Column:
    """a moment from ISO text; without a zone it is UTC; a leading date and time is enough; else null."""
    s = F.trim(text)
    s = F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(s, F.lit("T00:00:00"))).otherwise(s)
    start = F.regexp_extract(s, r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d)", 1)
    whole = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d+)?)?([zZ]|[+-]\d\d:?\d\d)$"), s).when(s.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d([.,]\d+)?)?$"), F.concat(s, F.lit("Z")))
    return F.coalesce(F.try_to_timestamp(F.translate(whole, ",", ".")), F.try_to_timestamp(F.concat(F.nullif(start, F.lit("")), F.lit("Z"))))


def snippet(text: Column, words: list[str], width: int = 160) -> Column:
    """``width`` characters from a third of it before the first word found, with marks where text is left out."""

    def cut(flat: Column) -> Column:
        found = [F.nullif(F.instr(F.lower(flat), F.lit(w)), F.lit(0)) for w in words]
        first = F.coalesce(F.array_min(F.array(*found)), F.lit(1)) - 1
        start = F.greatest(first - width // 3, F.lit(0))
        piece = F.substring(flat, start + 1, F.lit(width))
        return F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(start + width < F.length(flat), "…").otherwise(""))

    return let(squeeze(F.coalesce(text, F.lit(""))), cut)


def source_tag(source: Column) -> Column:
    """where a row came from; what the agent wrote itself has no mark."""
    return F.when(F.coalesce(source, F.lit("")).isin("", "agent", "checkpoint"), "").when(source.startswith("migrate"), "[imported]").otherwise(F.concat(F.lit("["), source, F.lit("]")))


def sparkline(values: Column) -> Column:
    """a bar of eight heights for each number, by the greatest one."""
    most = F.array_max(values)
    height = lambda v: F.when(most > 0, F.bround(7 * v / most)).otherwise(0).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), height(v) + 1, F.lit(1))), "")


def callee_name(raw: Column) -> Column:
    """a called name with dots for all its separators, without blanks; of a longer expression the last name behind a dot; too long ones are null."""

    def named(t: Column) -> Column:
        tail = F.regexp_replace(F.substring_index(t, ".", -1), r"[^\p{L}\p{N}_$]", "")
        return F.when((t == "") | (F.length(t) > 80), F.lit(None).cast("string")).when(t.rlike(r"[(\[{<]"), F.when(tail != "", F.concat(F.lit("."), tail))).when(t.startswith("..."), F.regexp_replace(t, r"^\.+", "")).otherwise(t)

    return let(F.regexp_replace(F.regexp_replace(raw, r"::|->|\?\.|\\", "."), r"\s+", ""), named)


def line_of(text: Column, pos: Column) -> Column:
    """the line, from 1, of a place, from 0."""
    before = F.substring(text, F.lit(1), pos)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def name_terms(name: Column) -> Column:
    """the significant words of a file name without its extension."""
    return terms(F.regexp_replace(F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", ""), "[^A-Za-z0-9_]+", " "))


def counted(n: Column, word: str, many: str | None = None) -> Column:
    """F32: a number with separators and its word."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, word).otherwise(many or word + "s"))


def size_text(n: Column) -> Column:
    """F32: bytes as KB, from a million on as MB."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(n / 1000, 0), F.lit(" KB")))


# How a record that does not hold is marked.
MARKS = {"rejected": " ✗ rejected", "superseded": " (superseded)", "retracted": " (retracted)", "done": " ✓ done", "fixed": " ✓ fixed", "dropped": " (dropped)", "retired": " (retired)"}


def hit_line(source: Column, label: Column, status: Column, priority: Column, tag: Column, when: Column, text: Column) -> Column:
    """A found record, turn, fold or symbol in one line; ``source`` is item, turn, fold or code."""
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[status], F.lit(""))
    own = F.concat(label, mark, F.when(priority, " !critical").otherwise(""), F.lit(" · "), when, F.lit(" · "), F.when(tag != "", F.concat(tag, F.lit(" "))).otherwise(""), text)
    return F.when(source == "turn", F.concat(label, F.lit(" "), status, F.lit(" · "), when, F.lit(" · "), text)).when(source == "fold", F.concat(label, F.lit(" fold:"), status, F.lit(" · "), when, F.lit(" · "), text)).when(source == "code", F.concat(F.lit("code "), status, F.lit(" "), text)).otherwise(own)
