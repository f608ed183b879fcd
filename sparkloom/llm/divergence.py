"""How far the sources of a language differ in their use of terms: sort-based streaming over (lang, term, source, document).

Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered; each row is
a document.  A task sorts its terms by (lang, term, source, document) in blocks of
bounded size; a scan of the runs gives documents and occurrences of each (lang,
term, source), so a term in every document leaves a task as one row.  These
partial runs are dealt by (lang, term, source), sorted again, and a streaming scan
joins them.  A lang keeps the terms in at least ``MIN_DOCS`` of its documents.

The kept terms of a lang are dealt in buckets of about ``BUCKET`` terms and its
sources in tiles of ``TILE``; a second sorted scan reads the totals of a tile's
sources first and then one run a term, and emits for each bucket partial sums of
the distances of source pairs, and the terms a source uses more than its lang.  The
output holds all pairs of sources of a lang, so it grows with their square.

``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))`` is computed in whole numbers,
for N + 5 * V up to 9 * 10**15.

Defined results: null text, lang and source are read as ''; a null or empty text has no
terms, but its (lang, source) still occurs; texts may be of any length (one text
must fit in a task); rows with equal doc_id, and equal rows, are documents of their
own; ties of value are ordered by the UTF-8 bytes of the item; a lang without kept
terms has pairs of value 0 and no terms; a lang with one source has no pairs; an empty
table gives an empty table; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

MIN_DOCS, TOP = 30, 50
BUCKET, TILE = 4096, 128
#: A task sorts texts of about so many bytes at once, and joins its runs when it holds so many.
SLICE, HELD = 4 << 20, 1 << 20
LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RUNS = "lang string, source string, term string, docs long, n long"
_FIELDS = ("lang", "source", "term", "docs", "n")


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (lang, source, text) with about ``size`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def ranks(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The rank of each value among the different ones, and these in order."""
    coded = column.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.empty(0, dtype=np.int64)


def local_runs(part: pa.RecordBatch) -> pa.Table:
    """Documents and occurrences of each (lang, term, source) in some rows; the empty term has the rows of each (lang, source)."""
    lang, langs = ranks(part.column(0))
    source, sources = ranks(part.column(1))
    by = np.lexsort((source, lang))  # document numbers in the order of (lang, source)
    number = np.empty(len(by), dtype=np.int64)
    number[by] = np.arange(len(by))
    lang, source = lang[by], source[by]
    lowered = [raw.translate(LETTER) for raw in part.column(2).to_pylist()]
    listed = pc.split_pattern(pa.array(lowered, pa.large_binary()), b" ")
    words, parent = listed.flatten(), number[pc.list_parent_indices(listed).to_numpy()]
    full = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(full).dictionary_encode()
    parent = parent[full.to_numpy(zero_copy_only=False)]
    terms, docs = len(coded.dictionary), len(by)
    # (lang, term, source, document) as one number: documents are numbered by (lang, source)
    key = np.sort((lang[parent] * terms + coded.indices.to_numpy()) * docs + parent)
    first = starts(key)
    seen, own = key[first], np.diff(np.append(first, len(key)))
    doc, pair = seen % docs, seen // docs
    run = starts(pair * (len(sources) + 1) + source[doc])
    groups = starts(lang * (len(sources) + 1) + source)
    heads = np.concatenate((doc[run], groups))
    return pa.table(
        [
            langs.take(pa.array(lang[heads])),
            sources.take(pa.array(source[heads])),
            pa.chunked_array([coded.dictionary.take(pa.array(pair[run] % max(1, terms))).cast(pa.binary()), pa.array([b""] * len(groups), pa.binary())], pa.binary()).combine_chunks(),
            pa.array(np.concatenate((np.diff(np.append(run, len(seen))), np.diff(np.append(groups, docs)))).astype(np.int64)),
            pa.array(np.concatenate((np.add.reduceat(own, run) if len(run) else own, np.zeros(len(groups), dtype=np.int64))).astype(np.int64)),
        ],
        names=_FIELDS,
    )


def joined(held: list[pa.Table]) -> pa.Table:
    """Partial runs with equal (lang, source, term) become one."""
    whole = pa.concat_tables(held)
    if len(held) == 1:
        return whole
    return whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(list(_FIELDS))


def runs(docs: DataFrame) -> DataFrame:
    """Partial runs of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, 0
        for batch in batches:
            for part in slices(batch, SLICE):
                held.append(local_runs(part))
                rows += held[-1].num_rows
                if rows > max(HELD, 2 * last):  # a few rounds of joining at most
                    held = [joined(held)]
                    rows = last = held[0].num_rows
                    if rows > 2 * HELD:
                        yield from out(held)
                        held, rows, last = [], 0, 0
        if held:
            yield from out([joined(held)])

    def out(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            t = t.set_column(2, "term", t.column("term").cast(pa.string()))
            yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    return rows.mapInArrow(run, RUNS)


def _change(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial runs (lang, source, term, docs, n), those of equal keys joined; only the last run is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        first = np.flatnonzero(_change([batch.column(i) for i in range(3)]))
        at = pa.array(first)
        sums = [pa.array(np.add.reduceat(batch.column(i).to_numpy(), first)) for i in (3, 4)]
        whole = pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(3)], *sums], schema=batch.schema)
        held = whole.slice(len(first) - 1)
        yield whole.slice(0, len(first) - 1)
    if held is not None:
        yield held


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents and occurrences; the term '' has the documents of each (lang, source)."""
    dealt = runs(docs).repartition("lang", "term", "source").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(scan, RUNS)


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / total) in whole numbers, three digits at a time."""
    whole, rest = np.divmod(count + 5, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


PARTS = "lang string, source string, part string, item string, value long"


def tile_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, x, y, bucket, term, source, block, n, lang_n, total, lang_total) to partial values.

    In each (lang, x, y, bucket) the rows of the empty term come first: the totals
    of the sources of the blocks x and y, and as n the number of terms of the bucket.
    Then each term is a run of its sources; terms that none of them has, have no run.
    """

    def emit(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def close() -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(np.triu(np.ones_like(state["sum"], dtype=bool), 1) & state["apart"])
        if len(a):
            none = probability(np.zeros_like(state["total"]), state["total"])
            state["sum"] += state["unseen"] * np.abs(none[:, None] - none[None, :])
            names, value = state["sources"], state["sum"][a, b]
            one, two = names.take(pa.array(a)), names.take(pa.array(b))
            yield emit(state["lang"], one, "pair", two, value)
            yield emit(state["lang"], two, "pair", one, value)

    def terms(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole runs of terms."""
        first = np.flatnonzero(_change([rows.column("term")]))
        names = rows.column("term").take(pa.array(first))
        term = np.cumsum(np.bincount(first, minlength=rows.num_rows)) - 1
        source = pc.index_in(rows.column("source"), state["sources"]).to_numpy(zero_copy_only=False).astype(np.int64)
        n, lang_n = rows.column("n").to_numpy(), rows.column("lang_n").to_numpy()
        total, width = state["total"], len(state["total"])
        state["unseen"] -= len(first)
        step = max(1, (1 << 20) // width)
        for lo in range(0, len(first), step):
            own = slice(*np.searchsorted(term, (lo, lo + step)))
            grid = np.zeros((min(step, len(first) - lo), width), dtype=np.int64)
            grid[term[own] - lo, source[own]] = n[own]
            p = probability(grid, total[None, :])
            for k in range(width - 1):
                state["sum"][k, k + 1 :] += np.abs(p[:, k : k + 1] - p[:, k + 1 :]).sum(axis=0)
            if state["x"] == state["y"]:  # every source is in one tile of its own block
                gain = p[term[own] - lo, source[own]] - probability(lang_n[own], state["lang_total"])
                up = np.flatnonzero((gain > 0) & (n[own] > 0))
                if len(up):
                    yield emit(state["lang"], state["sources"].take(pa.array(source[own][up])), "term", names.take(pa.array(term[own][up])), gain[up])

    state: dict = {}
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = None
        tile = np.flatnonzero(_change([batch.column(i) for i in range(4)]))
        for lo, hi in zip(tile, [*tile[1:], batch.num_rows], strict=True):
            rows = batch.slice(lo, hi - lo)
            if hi == batch.num_rows:  # the last run may go on
                run = np.flatnonzero(_change([rows.column("term")]))
                held = rows.slice(run[-1])
                rows = rows.slice(0, run[-1])
                if not rows.num_rows:
                    continue
            yield from advance(rows, state, terms, close)
    if held is not None:
        yield from advance(held, state, terms, close)
    if state:
        yield from close()


def advance(rows: pa.RecordBatch, state: dict, terms, close) -> Iterator[pa.RecordBatch]:
    """The next rows of one tile: its totals open it, its terms add to it."""
    heads = int(pc.sum(pc.equal(rows.column("term"), "")).as_py() or 0)
    if heads:
        if state:
            yield from close()
        top = rows.slice(0, heads)
        block = top.column("block").to_numpy()
        x, y = (top.column(c)[0].as_py() for c in ("x", "y"))
        state.update(lang=top.column("lang")[0].as_py(), x=x, y=y, sources=top.column("source"), total=top.column("total").to_numpy(), lang_total=top.column("lang_total")[0].as_py(), unseen=top.column("n")[0].as_py())
        state.update(sum=np.zeros((heads, heads), dtype=np.int64), apart=np.full((heads, heads), True) if x == y else block[:, None] != block[None, :])
    if rows.num_rows > heads:
        yield from terms(rows.slice(heads))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of the sources of a lang, and the terms each uses more than its lang."""
    found = counts(docs)
    each = Window.partitionBy("lang", "term")
    marked = found.withColumns({"lang_docs": F.sum("docs").over(each), "lang_n": F.sum("n").over(each), "nth": F.row_number().over(each.orderBy("source"))})
    kept = store(marked.where((F.col("lang_docs") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", "nth"), "kept")
    real = kept.where("term != ''")
    size = real.groupBy("lang").agg(F.sum(F.when(F.col("nth") == 1, 1)).alias("v"), F.sum("n").alias("lang_total"))
    groups = kept.where("term = ''").select("lang", "source").join(real.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(size, "lang", "left").select(
        "lang",
        F.ceil(F.col("sources") / TILE).alias("tiles"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / BUCKET)).alias("buckets"),
        (5 * F.coalesce("v", F.lit(0))).alias("more"),
        (F.coalesce("lang_total", F.lit(0)) + 5 * F.coalesce("v", F.lit(0))).alias("lang_total"),
    )
    of_lang = store(of_lang, "langs")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    block = F.pmod(F.xxhash64("source"), F.col("tiles"))

    def tiled(rows: DataFrame, bucket, *columns) -> DataFrame:
        inner = rows.withColumn("block", block).withColumn("other", other).withColumn("bucket", bucket)
        return inner.select("lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "bucket", *columns)

    shape = ["term", "source", "block", "n", "lang_n", "total", "lang_total"]
    zero = F.lit(0).cast("long")
    number = F.pmod(F.xxhash64("term"), F.col("buckets"))
    terms = real.where("nth = 1").join(of_lang, "lang").groupBy("lang", number.alias("bucket")).agg(F.count("*").alias("n"))
    opened = groups.join(of_lang, "lang").withColumn("bucket", F.explode(F.sequence(zero, F.col("buckets") - 1))).join(terms, ["lang", "bucket"], "left")
    heads = tiled(opened, F.col("bucket"), F.lit("").alias("term"), "source", "block", F.coalesce("n", zero).alias("n"), zero.alias("lang_n"), (F.coalesce("total", F.lit(0)) + F.col("more")).alias("total"), "lang_total").select("lang", "x", "y", "bucket", *shape)
    body = tiled(real.join(of_lang, "lang"), number, "term", "source", "block", "n", "lang_n", zero.alias("total"), zero.alias("lang_total")).select("lang", "x", "y", "bucket", *shape)
    keys = ["lang", "x", "y", "bucket"]
    parts = heads.unionByName(body).repartition(*keys).sortWithinPartitions(*keys, "term", "source").mapInArrow(tile_scan, PARTS)
    parts = store(parts, "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)
