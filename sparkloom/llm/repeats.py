"""Removal of repeated passages with shard-wise suffix arrays.

Every 100-byte window has an anchor: the least hash of the 32-byte strings in it.
Equal windows have equal anchors, so windows are dealt by anchor and never
compared across shards.  A run of windows with one anchor value is a segment; it
is about 134 bytes for 35 windows.

1. A task cuts its documents into segments and keeps the first of equal ones; the
   others are repeats as they stand.  One row per content and task is dealt on, so
   a passage that all documents share costs a row per task.
2. By anchor, equal contents are resolved to the first one.  Anchors that stand in
   different contents (or twice in one) need their text compared.
3. Those texts are fetched once, gathered into shards of about ``SHARD`` bytes, and
   each shard's suffix array is induced; places whose permuted common prefix
   reaches the window length are equal windows, and all but the first go.  An
   anchor with more than ``HOT`` contents is not gathered: its windows are dealt one
   by one, by 128 bits of their bytes, and resolved as in step 2.

Contents are compared by a 64-bit hash beside the 64-bit anchor, which is a hash
of another part of them; texts of a shard by their bytes.

Defined results: null and empty texts have nothing to remove; texts shorter than a
window stay; texts may be of any length (one text must fit in a task); equal rows (of
doc_id and text) are one text at one place, and neither is a repeat of the other;
rows of one doc_id with different texts are documents of their own, in the order of
their digests; a null doc_id is the smallest; an empty table gives an empty table;
other columns do not matter.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import store, texts
from .groups import Group, map_all_groups, map_groups
from .ppm import _batch
from .shingles import mix
from .suffix import permuted_lcp, suffix_array

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1  # 32-byte strings in a window
SHARD, HOT = 1 << 20, 16384
PART = 1 << 18  # bytes hashed at a time
TASK_SEGMENTS = 400_000
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xC2B2AE3D27D4EB4F)
NULL_ID = -(1 << 63)
#: A segment's windows start at pos, pos + 1, ..., pos + n - 1.
SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("pos", "<i8"), ("n", "<i8"), ("twice", "<i8")])
MARKS = "doc_id long, kind int, pos long, n long, key long, data binary"
MARK, COMPARE, SPREAD, TEXT = 0, 1, 2, 3

def _trim() -> None:
    """Give freed memory back: workers live on, and what their allocator holds counts against the executor."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _contents(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the given ranges of bytes."""
    view = memoryview(raw)
    ends = (start + size).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), ends, strict=True)), np.uint64, len(ends))


def _slide(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        h = pick(h[:-have], h[have:])
        have *= 2
    return pick(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def segments(raw: bytes, doc: int, first: int = 0) -> np.ndarray:
    """The segments of one text, or of a part that begins at ``first``."""
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=SEGMENT)
    size = len(raw) - GRAM + 1
    h = np.zeros(size, dtype=np.uint64)
    for at in range(0, GRAM, 8):
        h = (h ^ (h >> np.uint64(29)) ^ np.ndarray(size, dtype="<u8", buffer=raw, offset=at, strides=(1,))) * _C
    h = mix(h)
    anchor = _slide(h, SPAN, True)
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(start, n))
    out = np.zeros(len(start), dtype=SEGMENT)
    out["anchor"], out["content"], out["doc"], out["pos"], out["n"] = anchor[start], _contents(raw, start, count + WINDOW - 1), doc, start + first, count
    # Does the anchor stand twice in a segment? Only then may a window repeat inside it.
    edge = np.concatenate((np.zeros(SPAN - 1, np.uint64), anchor, np.zeros(SPAN - 1, np.uint64)))
    chosen = np.flatnonzero(_slide(edge, SPAN, False) == h)
    values, which = np.unique(np.concatenate((out["anchor"], h[chosen])), return_inverse=True)
    key = np.sort(which[len(out) :] * (len(h) + 1) + chosen)
    own = which[: len(out)] * (len(h) + 1)
    out["twice"] = np.searchsorted(key, own + start + count + SPAN - 1) - np.searchsorted(key, own + start) > 1
    return out


def cut(raw: bytes, doc: int) -> Iterator[np.ndarray]:
    """Segments of a text of any length; parts overlap by a window less a byte, so every window is in one part."""
    for at in range(0, max(1, len(raw) - WINDOW + 1), PART):
        yield segments(raw[at : at + PART + WINDOW - 1], doc, at)


def resolve(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments sorted by anchor and content, the first occurrence foremost; whether each is that first one)."""
    s = s[np.argsort(s["anchor"])]
    tie = np.zeros(len(s), dtype=bool)
    equal = s["anchor"][1:] == s["anchor"][:-1]
    tie[1:] |= equal
    tie[:-1] |= equal
    at = np.flatnonzero(tie)  # few: most anchors stand alone
    t = s[at]
    s[at] = t[np.lexsort((t["pos"], t["doc"], t["n"], t["content"], t["anchor"]))]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s["anchor"][1:] != s["anchor"][:-1]) | (s["content"][1:] != s["content"][:-1]) | (s["n"][1:] != s["n"][:-1])
    return s, new


def pack(s: np.ndarray) -> bytes:
    """Segments by field and byte, so that high bytes, which are mostly equal, stand together for the compressor."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(s[f]).view(np.uint8).reshape(len(s), 8).T).tobytes() for f in SEGMENT.names)


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // SEGMENT.itemsize
    out = np.zeros(n, dtype=SEGMENT)
    for k, f in enumerate(SEGMENT.names):
        part = np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=8 * n * k).reshape(8, n)
        out[f] = np.ascontiguousarray(part.T).view(SEGMENT[f]).reshape(n)
    return out


def merged(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Windows as runs of neighbours."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    lead = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)))) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros(len(lead), dtype=SEGMENT)
    out["doc"], out["pos"], out["n"] = doc[lead], pos[lead], np.diff(np.append(lead, len(doc)))
    return out


def _repeats(s: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Those that start later than the first one; the same place again (a repeated row) is no repeat."""
    if not len(s):
        return s
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return s[(s["doc"] != s["doc"][lead]) | (s["pos"] != s["pos"][lead])]


def _rows(kind: int, s: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(s)
    return pa.RecordBatch.from_arrays(
        [pa.array(s["doc"].copy()), pa.array(np.full(n, kind, np.int32)), pa.array(s["pos"].copy()), pa.array(s["n"].copy()), pa.array(np.zeros(n, np.int64) if key is None else key), pa.nulls(n, pa.binary())], names=["doc_id", "kind", "pos", "n", "key", "data"]
    )


def _dealt(s: np.ndarray, buckets: int, by: str) -> pa.RecordBatch:
    """Segments as one blob a bucket: doc_id holds the bucket's number."""
    to = (mix(s[by] ^ _D) % np.uint64(buckets)).astype(np.int64)
    s = s[np.argsort(to, kind="stable")]
    found, first = np.unique(np.sort(to), return_index=True)
    return _batch([(int(b), SPREAD, 0, 0, 0, pack(x)) for b, x in zip(found, np.split(s, first[1:]), strict=True)] if len(s) else [], MARKS)


def _collect(buckets: int):
    """Cut documents into segments; repeats within the task are marked at once, the rest is dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, new = resolve(np.concatenate(held))
            held.clear()
            yield _rows(MARK, _repeats(s, new))
            yield _dealt(s[new], buckets, "anchor")
            del s, new
            _trim()

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in cut(raw, doc):
                    held.append(part)
                    size += len(part)
                if size > TASK_SEGMENTS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def _match(group: Group, limit: int = HOT) -> Iterator[pa.RecordBatch]:
    """A bucket of segments: repeats are marked; contents that share an anchor are to be compared."""
    s, new = resolve(np.concatenate([unpack(x) for x in group["data"]]))
    yield _rows(MARK, _repeats(s, new))
    one = s[new]
    lead = np.concatenate(([True], one["anchor"][1:] != one["anchor"][:-1]))
    group_of = np.cumsum(lead) - 1
    contents = np.bincount(group_of)[group_of]
    hot = contents > limit
    few = ~hot & ((contents > 1) | (np.bincount(group_of, one["twice"])[group_of] > 0))
    yield _rows(COMPARE, one[few], one["anchor"][few].view(np.int64))
    yield _rows(SPREAD, one[hot], one["anchor"][hot].view(np.int64))
    del s, new, one
    _trim()


def _windows(raw: bytes, doc: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each window of the given segments on its own, named by 128 bits; n is 0 as a sign."""
    starts = np.concatenate([np.arange(p, p + k) for p, k in zip(pos, n, strict=True)])
    view = memoryview(raw)
    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[p : p + WINDOW]) for p in starts.tolist()), dtype="<u8").reshape(-1, 2)
    out = np.zeros(len(starts), dtype=SEGMENT)
    out["anchor"], out["content"], out["doc"], out["pos"] = names[:, 0], names[:, 1], doc, starts
    return out


def _covered(size: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + n + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(doc: int, raw: bytes, pos: np.ndarray, n: np.ndarray, keep: bool) -> tuple:
    gone = _covered(len(raw), pos, n) if len(pos) else np.zeros(len(raw), dtype=bool)
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes() if spans else raw
    return (None if doc == NULL_ID else doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep else None)


def _columns(group: Group, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = group["kind"] == kind
    return tuple(group[c][at] for c in ("pos", "n", "key"))


def _texts_of(group: Group) -> list[bytes]:
    return [group["data"][i] for i in np.flatnonzero(group["kind"] == TEXT)]


def _fetch(shards: int, buckets: int, keep: bool):
    """A document with its marks: done if nothing is to be compared; else its texts to compare, and itself for the last step."""
    schema = f"stage int, {RESULT}, pos array<long>, n array<long>, shard long, key long"

    def one(group: Group) -> Iterator[tuple]:
        doc = int(group["doc_id"][0])
        pos, n, _ = _columns(group, MARK)
        c_pos, c_n, c_key = _columns(group, COMPARE)
        s_pos, s_n, _ = _columns(group, SPREAD)
        for raw in _texts_of(group):
            ok = pos + n + WINDOW - 1 <= len(raw)  # rows with equal doc_id may differ in length
            if not len(c_pos) and not len(s_pos):
                yield (0, *_result(doc, raw, pos[ok], n[ok], keep), None, None, None, None)
                continue
            yield 1, doc, len(raw), 0, 0, None, raw, pos[ok].tolist(), n[ok].tolist(), None, None
            to = (mix(c_key.view(np.uint64)) % np.uint64(shards)).tolist()
            for p, k, key, shard in zip(c_pos.tolist(), c_n.tolist(), c_key.tolist(), to, strict=True):
                if p + k + WINDOW - 1 <= len(raw):
                    yield 2, doc, 0, 0, 0, None, raw[p : p + k + WINDOW - 1], [p], None, shard, key
            ok = s_pos + s_n + WINDOW - 1 <= len(raw)
            if ok.any():
                w = _windows(raw, doc, s_pos[ok], s_n[ok])
                to = (mix(w["anchor"] ^ _D) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(to):
                    yield 3, doc, 0, 0, 0, None, pack(w[to == b]), None, None, int(b), None

    long = pa.int64()
    kinds = [pa.int32(), long, long, long, long, pa.string(), pa.binary(), pa.list_(long), pa.list_(long), long, long]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(groups: Iterator[Group]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(one, groups, 6):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run, schema


def _compare(group: Group) -> Iterator[pa.RecordBatch]:
    """A shard: its segments are joined (each ended by a letter of its own kind), sorted, and equal windows resolved."""
    data, doc, pos = group["kept"], group["doc_id"], group["pos"]
    sizes = np.array([len(x) + 1 for x in data])
    text = np.frombuffer(b"".join(x + b"\0" for x in data), dtype=np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)
    alone = lcp[sa] < WINDOW
    klass = np.cumsum(alone)
    paired = ~alone
    paired[:-1] |= paired[1:]  # the first of each class too
    place, klass = sa[paired], klass[paired]
    of = np.searchsorted(ends, place, side="right")
    offset = place - (ends - sizes)[of]
    use = offset + WINDOW < sizes[of]  # a whole window before the segment's end
    place, klass, of, offset = place[use], klass[use], of[use], offset[use]
    d = np.array(doc, dtype=np.int64)[of]
    p = np.array([x[0] for x in pos], dtype=np.int64)[of] + offset
    order = np.lexsort((p, d, klass))
    d, p, klass = d[order], p[order], klass[order]
    lead = np.concatenate(([True], klass[1:] != klass[:-1])) if len(klass) else np.zeros(0, bool)
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(klass) else lead
    later = (d != d[first]) | (p != p[first])
    yield _rows(MARK, merged(d[later], p[later]))
    del text, sa, lcp, of, offset, klass, alone, paired
    _trim()


def _match_windows(group: Group) -> Iterator[pa.RecordBatch]:
    s, new = resolve(np.concatenate([unpack(x) for x in group["kept"]]))
    found = _repeats(s, new)
    yield _rows(MARK, merged(found["doc"], found["pos"]))


def _finish(keep: bool):
    def one(group: Group) -> Iterator[tuple]:
        doc = int(group["doc_id"][0])
        pos, n, _ = _columns(group, MARK)
        for raw, k, q, m in zip(*(group[c] for c in ("data", "kind", "more_pos", "more_n")), strict=True):
            if k == TEXT:
                ok = pos + n + WINDOW - 1 <= len(raw)
                yield _result(doc, raw, np.concatenate((pos[ok], np.array(q, np.int64))), np.concatenate((n[ok], np.array(m, np.int64))), keep)

    def run(groups: Iterator[Group]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(one, groups, 5):
            yield _batch(rows, RESULT)

    return run


def _batches(one, groups: Iterator[Group], data: int, rows: int = 4000, size: int = 4 << 20) -> Iterator[list[tuple]]:
    """The rows of many groups together; ``data`` is the place of their bytes, which bound a batch too."""
    held: list[tuple] = []
    total = 0
    for group in groups:
        for row in one(group):
            held.append(row)
            total += len(row[data] or b"")
            if len(held) >= rows or total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, and what is kept (its digest always, the bytes when ``keep``)."""
    source = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    name = F.unhex(F.md5("text"))
    named = store(source.select("doc_id", name.alias("name")).distinct(), "named")
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return _without_repeats(source, keep, shard, hot)
    # texts that share a doc_id: every different one gets a number of its own in the same order
    numbers = store(numbered(named, [], ["doc_id", "name"], "number"), "numbers")
    own = source.withColumn("name", name).join(numbers, ["doc_id", "name"]).select(F.col("number").alias("doc_id"), "text")
    found = _without_repeats(own, keep, shard, hot)
    back = numbers.select(F.col("number").alias("doc_id"), F.nullif("doc_id", F.lit(NULL_ID)).alias("_id"))
    return found.join(back, "doc_id").withColumn("doc_id", F.col("_id")).select(*found.columns)


def _without_repeats(source: DataFrame, keep: bool, shard: int, hot: int) -> DataFrame:
    """As ``remove_repeats`` for (doc_id, text) in which one doc_id has one text."""
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(16, size // (4 << 20))
    cut_up = store(source.mapInArrow(_collect(buckets), MARKS), "segments")
    dealt = cut_up.where(F.col("kind") == SPREAD).select(F.col("doc_id").alias("bucket"), "data")
    matched = store(map_groups(dealt, ["bucket"], partial(_match, limit=hot), MARKS), "matched")
    marks = cut_up.where(F.col("kind") == MARK).unionByName(matched)
    compare = matched.where(F.col("kind") == COMPARE).agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0
    nothing = F.lit(None).cast("binary")
    rows = marks.withColumn("data", nothing).unionByName(source.select("doc_id", F.lit(TEXT).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("key"), F.col("text").alias("data")))
    fetch, schema = _fetch(max(1, -(-compare // shard)), buckets, keep)
    fetched = store(map_all_groups(rows, ["doc_id"], fetch, schema), "fetched")
    found = map_groups(fetched.where("stage = 2").select("shard", "doc_id", "pos", "kept"), ["shard"], _compare, MARKS)
    spread = map_groups(fetched.where("stage = 3").select("shard", "kept"), ["shard"], _match_windows, MARKS)
    late = fetched.where("stage = 1").select("doc_id", F.lit(TEXT).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("key"), F.col("kept").alias("data"), F.col("pos").alias("more_pos"), F.col("n").alias("more_n"))
    none = F.lit(None).cast("array<long>")
    rest = map_all_groups(found.unionByName(spread).withColumns({"more_pos": none, "more_n": none}).unionByName(late), ["doc_id"], _finish(keep), RESULT)
    names = [x.split()[0] for x in RESULT.split(", ")]
    return fetched.where("stage = 0").select(*names).unionByName(rest)
