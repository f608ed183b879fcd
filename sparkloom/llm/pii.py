"""Personal data: base patterns, and terms that disclose them.

Only DataFrame functions are used.  Base spans are e-mail addresses, IPv4
addresses, payment cards and phone numbers.  Each value found is a protected
entity.  A term (a word of four letters or more) near an entity discloses it as
far as the entity's information content is explained by the term:

    PMI(e; t) / IC(e) = ln(co * N / (df_e * df_t)) / ln(N / df_e)

with N different texts, df those that hold e or t, and co those where t stands
within ``WINDOW`` characters of e; so copies of a document change nothing.  A term
that reaches ``THRESHOLD`` counts with evidence: ``SUPPORT`` different contexts
(exact copies of a context count once), or fewer, of an entity however rare, if
chance would hardly put the two together: the bound (df_e * df_t / N) ** co on that
is at most ``CHANCE``.  All occurrences of such a term, in any text, are spans of
kind ``term``.  Terms that reach ``REMOVE`` for an entity are removed.  The others
are generalised: to the rarest term that stands in at least ``SUBSUMES`` of the
contexts of the disclosing one, is more frequent in the corpus and discloses
nothing itself (so it is the more general one of the two); to ``[TERM]`` where
there is none.

Every different text (by 128 bits of it) is looked at once; its spans then go to
all rows that have it.

Defined results: a null or empty text has no spans; texts may be of any length;
equal texts have equal spans; positions are code points; an empty table gives an
empty table; rows may repeat; other columns are carried by ``detect`` (in ``row``)
and ``sanitise`` as they are, whatever their names, and do not matter elsewhere.

The patterns are possessive and start only where a match can start, so a long
run of one character is read once; they match as the plain patterns do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, unused
from .groups import join_one

WINDOW, SUPPORT, THRESHOLD, REMOVE = 80, 3, 0.9, 0.99
CHANCE = 0.001
SUBSUMES = 0.8
NO_TERM = "[TERM]"
BASE = ("email", "ip", "card", "phone")
_MAIL = r"[A-Za-z0-9._%+-]"
#: A pattern for each kind, and a cheap test that any text with a match passes.
PATTERNS = {
    "email": (rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    # Chains of digits with single separators, of 16 to 19 digits: shorter and longer ones would be dropped.
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
TERM = r"\p{L}{4,}+"
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def spans(text: Column, pattern: str) -> Column:
    """All matches with their places, from what stands between them: running lengths in blocks of 64, so the work is near linear."""
    size = 64

    def placed(x: Column) -> Column:
        def totals(t: Column) -> Column:
            def with_blocks(b: Column) -> Column:
                def start(h: Column, i: Column) -> Column:
                    k = F.floor(i / size).cast("int")
                    at = F.element_at(b, k + 1) + _sum(F.slice(t, k * size + 1, i - k * size)) + F.length(F.element_at(x["parts"], i + 1))
                    return F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("value"))

                return F.transform(x["hits"], start)

            count = F.ceil(F.size(t) / size).cast("int")
            sums = F.transform(F.sequence(F.lit(0), count - 1), lambda k: _sum(F.slice(t, k * size + 1, size)))
            return let(sums, lambda s: let(F.transform(s, lambda _, k: _sum(F.slice(s, 1, k))), with_blocks))

        return let(F.transform(x["hits"], lambda h, i: F.length(h) + F.length(F.element_at(x["parts"], i + 1))), totals)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("parts"))
    return let(found, lambda x: F.when(F.size(x["hits"]) > 0, placed(x)).otherwise(F.array().cast(SPAN)))


def _small(part: Column) -> Column:
    """A number of at most 255, however many zeros stand before it."""
    tail = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(tail) <= 3) & (F.when(F.length(tail) <= 3, tail.cast("int")) <= 255)


def _luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        def digit(i: Column) -> Column:  # i from 1 at the right end
            n = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

        return _sum(F.transform(F.sequence(F.lit(1), F.length(d)), digit)) % 10 == 0

    return let(F.regexp_replace(value, "[ -]", ""), check)


def _kept(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.filter(found, lambda s: F.forall(F.split(s["value"], r"\."), _small))
    if kind == "card":
        return F.filter(found, lambda s: _luhn(s["value"]))
    if kind == "phone":
        return F.filter(found, lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(8, 15))
    return found


def base(docs: DataFrame, text_col: str = "_text") -> DataFrame:
    """Add the columns email, ip, card and phone: the base spans of each kind."""
    text = F.col(text_col)
    out = {}
    for kind in BASE:
        pattern, gate = PATTERNS[kind]
        passes = F.instr(text, "@") > 0 if kind == "email" else text.rlike(gate)
        out[f"_{kind}"] = F.when(passes, _kept(kind, spans(text, pattern))).otherwise(F.array().cast(SPAN))
    return docs.withColumns(out)


def _all(*kinds: str) -> Column:
    def named(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(named, kinds))


RUN = "struct<start:int,end:int,term:int,size:int,tag:string>"


def merged(found: Column) -> Column:
    """The unions of overlapping spans (start, end, term, tag); the tag is that of a base span before a term, then of the longest."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["term"].alias("term"), s["tag"].alias("tag"))))
    runs = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["term"].alias("term"), (-s["back"] - s["start"]).alias("size"), s["tag"].alias("tag")).cast(RUN))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        better = (s["term"] < last["term"]) | ((s["term"] == last["term"]) & (s["size"] > last["size"]))
        best = F.when(better, s).otherwise(last)
        union = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), best["term"].alias("term"), best["size"].alias("size"), best["tag"].alias("tag")).cast(RUN)
        return F.when(s["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(union))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(runs, F.array().cast(f"array<{RUN}>"), step)


def replaced(text: Column, runs: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with ``by(run)`` in place of each run; the runs do not overlap."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s))).alias("out"))

    return F.aggregate(runs, begin, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))))


def _some(*kinds: str) -> Column:
    return sum((F.size(f"_{k}") for k in kinds), F.lit(0)) > 0


def prose(found: DataFrame) -> DataFrame:
    """Add _plain: the text with blanks in place of base spans, where terms are looked for."""
    runs = merged(F.transform(_all(*BASE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("term"), F.lit("").alias("tag"))))
    blank = replaced(F.col("_text"), runs, lambda r: F.repeat(F.lit(" "), r["end"] - r["start"]))
    return found.withColumn("_plain", F.when(_some(*BASE), blank))


def occurrences(found: DataFrame) -> DataFrame:
    """A row for each base span: its document (by the hash of its text), its entity, its context, and the terms there."""
    one = found.where(_some(*BASE)).select("_hash", "_text", "_plain", F.explode(_all(*BASE)).alias("s"))
    low, high = F.greatest(F.col("s.start") - WINDOW, F.lit(0)), F.col("s.end")

    def around(text_col: str) -> tuple[Column, Column]:
        return F.substring(F.col(text_col), low + 1, F.col("s.start") - low), F.substring(F.col(text_col), high + 1, F.lit(WINDOW))

    (left, right), (left_plain, right_plain) = around("_text"), around("_plain")
    cut = one.select("_hash", F.col("s.kind").alias("kind"), F.lower("s.value").alias("value"), F.xxhash64(left, right).alias("context"), left_plain.alias("left"), right_plain.alias("right"), low.alias("low"), high.alias("high"), (high + WINDOW < F.length("_text")).alias("more"))

    def terms(context: Column, whole: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(spans(context, TERM), whole), lambda t: F.lower(t["value"]))

    before = terms(F.col("left"), lambda t: (t["start"] > 0) | (F.col("low") == 0))  # a word that the window cuts is no term
    after = terms(F.col("right"), lambda t: (t["end"] < WINDOW) | ~F.col("more"))
    return cut.select("_hash", "kind", "value", "context", F.array_distinct(F.concat(before, after)).alias("terms"))


def words_of(text: Column) -> Column:
    """The different terms of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def frequencies(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """(term, df_t) of the terms in any context: in how many texts each is."""
    corpus = texts.select(F.explode(words_of(F.coalesce("_plain", "_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    return corpus.join(seen.select(F.explode("terms").alias("term")).distinct().hint("merge"), "term", "left_semi")


def disclosing(n: int, counts: DataFrame, seen: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, value, term, disclosure) of the terms that reveal an entity; ``n`` texts, ``counts`` from ``frequencies``."""
    entity = seen.groupBy("kind", "value").agg(F.countDistinct("_hash").alias("df_e"))
    words = seen.select("_hash", "kind", "value", "context", F.explode("terms").alias("term"))
    pairs = words.groupBy("kind", "value", "term").agg(F.countDistinct("_hash").alias("co"), F.countDistinct("context").alias("contexts"))
    joined = counts.join(pairs, "term").join(entity, ["kind", "value"])
    texts = F.lit(n)
    information = F.log(texts / F.col("df_e"))
    score = F.when(information > 0, F.log(F.col("co") * texts / (F.col("df_e") * F.col("df_t"))) / information).otherwise(F.lit(0.0))
    chance = F.col("co") * F.log(F.col("df_e") * F.col("df_t") / texts)
    evidence = (F.col("contexts") >= support) | (chance <= math.log(CHANCE) + 1e-9)
    return joined.where(evidence).select("kind", "value", "term", F.round(score, 6).alias("disclosure")).where(F.col("disclosure") >= threshold)


def actions(known: DataFrame, counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(term, action): what stands in place of each disclosing term, nothing where it is removed."""
    worst = known.groupBy("term").agg(F.max("disclosure").alias("worst")).join(counts, "term")
    contexts = seen.dropDuplicates(["context", "terms"]).select("terms", F.explode("terms").alias("term"))
    mild = worst.where(F.col("worst") < REMOVE).select("term", "df_t")
    held = contexts.join(mild, "term").select("term", "df_t", F.explode("terms").alias("general"))
    together = held.groupBy("term", "df_t", "general").agg(F.count("*").alias("n"))
    all_ = together.where("term = general").select("term", F.col("n").alias("of"))
    wider = together.join(all_, "term").where(F.col("n") >= SUBSUMES * F.col("of"))
    wider = wider.join(counts.select(F.col("term").alias("general"), F.col("df_t").alias("df_g")), "general").where("df_g > df_t").join(known.select(F.col("term").alias("general")).distinct(), "general", "left_anti")
    best = wider.groupBy("term").agg(F.min(F.struct("df_g", "general"))["general"].alias("general"))
    replacement = F.when(F.col("worst") >= REMOVE, F.lit("")).otherwise(F.coalesce("general", F.lit(NO_TERM)))
    return worst.join(best, "term", "left").select("term", replacement.alias("action"))


def holding(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(_hash, _known): what replaces each term of ``known`` (term, action), for the texts that hold one."""
    held = texts.select("_hash", F.explode(words_of(F.coalesce("_plain", "_text"))).alias("term")).join(known, "term")
    return held.groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("_known"))  # at most the terms of one text


def flagged(found: DataFrame) -> DataFrame:
    """Add _term: the spans of all occurrences of the terms in ``_known``, none where it is null."""
    at = F.transform(spans(F.coalesce("_plain", "_text"), TERM), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.col("_known")[F.lower(t["value"])].alias("value")))
    return found.withColumn("_term", F.when(F.col("_known").isNotNull(), F.filter(at, lambda t: t["value"].isNotNull())).otherwise(F.array().cast(SPAN)))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def analysed(docs: DataFrame, text_col: str, support: int, threshold: float) -> DataFrame:
    """(_hash, _text, rows, _email, ..., _term) of every different text that has a span."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    once = docs.select(text.alias("_text")).where("_text <> ''").withColumn("_hash", _key(F.col("_text"))).groupBy("_hash").agg(F.first("_text").alias("_text"), F.count("*").alias("rows"))
    texts = store(prose(base(once)), "texts", "zstd")
    empty = docs.where(text == "").limit(1).count()  # the empty text is one of the different ones
    seen = store(occurrences(texts), "occurrences")
    counts = store(frequencies(texts, seen), "frequencies")
    known = store(disclosing(texts.count() + empty, counts, seen, support, threshold), "disclosing")
    held = store(holding(texts, store(actions(known, counts, seen), "terms")), "held")
    # Merged at every size: texts that hold a term grow with the corpus.
    either = texts.join(held.hint("merge"), "_hash", "left").where(_some(*BASE) | F.col("_known").isNotNull())
    return flagged(either).drop("_plain", "_known")


KINDS = (*BASE, "term")


def detect(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` as the struct ``row``, and email, ip, card, phone and term: arrays of spans; a term's value is what replaces it."""
    found = analysed(docs, text_col, support, threshold).select("_hash", "rows", *(F.col(f"_{k}").alias(k) for k in KINDS))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    return join_one(rows, found, "_hash", "left").select("row", *(F.coalesce(k, F.array().cast(SPAN)).alias(k) for k in KINDS))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as a string."""

    def places(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    listed = {k: places(k) for k in KINDS}
    first = F.concat_ws(",", *(listed[k] for k in BASE))
    return found.select(
        F.col("row")[id_col].alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(first.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", *(listed[k] for k in KINDS)).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base spans replaced by what kind they are, and disclosing terms removed or generalised; of overlapping spans all goes, under one name."""

    def tagged(s: Column) -> Column:
        tag = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["kind"] == "term").cast("int").alias("term"), tag.alias("tag"))

    found = analysed(docs, text_col, support, threshold)
    clean = replaced(F.col("_text"), merged(F.transform(_all(*KINDS), tagged)), lambda r: r["tag"])
    key, new = unused(docs, "_hash"), unused(docs, "_clean")
    rows = docs.withColumn(key, _key(F.coalesce(F.col(text_col), F.lit(""))))
    count = unused(docs, "rows")
    joined = join_one(rows, found.select(F.col("_hash").alias(key), F.col("rows").alias(count), clean.alias(new)), key, "left", count)
    return joined.select(*[F.coalesce(F.col(new), F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
