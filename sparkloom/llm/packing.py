"""Best-fit packing by bin-completion branch and bound.

Lengths are at most ``capacity``, so the packing problem is a histogram of at
most ``capacity`` entries whatever the number of documents.  The driver solves
that histogram: around the largest length left it enumerates fillings of the
rest of a bin by increasing waste, skips those that another one dominates, and
applies each as often as the counts allow.  The first descent (always the
fullest bin, larger pieces first: best fit) gives the incumbent; the search
stops when the incumbent meets the lower bound and prunes branches whose waste
cannot beat it.  ``node_budget``, ``width`` (fillings tried at a node) and
``tries`` (steps to enumerate them) bound the search, never the result: every
piece is packed.  With None for all three the search is exhaustive.

Full pieces are a sequence each.  The others find their place by rank: the r-th
piece of a length goes to the r-th slot of that length.  Ranks come from counts
by (length, bucket), with buckets of about ``PER_BUCKET`` rows, so no length,
however common, meets in one task.

Ids are those of the tokenizers library, word by word (``words``).

Defined results: a null or empty text is its end token alone; texts of any
length, of one character throughout too, are encoded whole; documents with equal
ids or texts are packed one by one; an empty table gives an empty table; other
columns, whatever their names, do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, store, texts
from .words import words_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PER_BUCKET = 100_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _batches(part: pa.RecordBatch, size: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of some rows at a time, of about ``size`` bytes."""
    docs, held, total = [], [], 0
    for doc, raw in zip(part.column(0), part.column(1), strict=True):
        docs.append(doc.as_py())
        held.append(raw.as_py().decode("utf-8", "replace"))
        total += len(held[-1])
        if total >= size or len(held) >= 1024:
            yield docs, held
            docs, held, total = [], [], 0
    if held:
        yield docs, held


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece, with its ids when ``keep_ids``; ``vocabulary`` is a JSON file of the tokenizers library."""
    out = PIECES + (", ids array<int>" if keep_ids else "")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words_of(vocabulary)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for own_docs, own_texts in _batches(batch):
                rows: list[tuple] = []
                for doc, ids in zip(own_docs, encoder.encode(own_texts), strict=True):
                    ids = np.concatenate((np.frombuffer(ids, dtype="<u4"), end))
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[s : s + n]
                        rows.append((doc, k, s, n, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[i]) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return texts(docs, id_col, text_col).mapInArrow(run, out)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: pieces over half a bin stay alone with what fits beside them."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counts.items():
        n[length] = c
    mass = n * np.arange(capacity + 1)
    best = -(-int(mass.sum()) // capacity)
    for a in range(capacity // 2 + 1):
        large, middle = int(n[capacity - a + 1 :].sum()), int(n[capacity // 2 + 1 : capacity - a + 1].sum())
        room = middle * capacity - int(mass[capacity // 2 + 1 : capacity - a + 1].sum())
        best = max(best, large + middle + max(0, -(-(int(mass[a : capacity // 2 + 1].sum()) - room) // capacity)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be put into those of ``a`` (first fit, larger first): then ``a`` leaves no less to pack well."""
    room = sorted(a, reverse=True)
    for x in sorted(b, reverse=True):
        for i, r in enumerate(room):
            if x <= r:
                room[i] -= x
                break
        else:
            return False
    return True


def fillings(counts: dict[int, int], rest: int, width: int | None, tries: int | None = 4000) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of ``rest`` (None: all), by increasing waste, larger pieces first."""
    sizes = sorted((s for s, c in counts.items() if c > 0 and s <= rest), reverse=True)
    if not sizes:
        return [()]
    reach = [0] * (len(sizes) + 1)  # reach[i]: bit b is set if sizes[i:] can sum to b
    full = (1 << (rest + 1)) - 1
    reach[len(sizes)] = 1
    for i in range(len(sizes) - 1, -1, -1):
        r, step = reach[i + 1], sizes[i]
        most = min(counts[step], rest // step)
        have = 1
        while most:  # doubling, so the counts are kept exactly
            take = min(have, most)
            r |= (r << (step * take)) & full
            most -= take
            have *= 2
        reach[i] = r
    out: list[tuple[int, ...]] = []
    left = [tries]

    def over() -> bool:
        return width is not None and len(out) >= width or left[0] is not None and left[0] < 0

    def walk(i: int, need: int, chosen: list[int]) -> None:
        if left[0] is not None:
            left[0] -= 1
        if over():
            return
        if need == 0:
            found = tuple(chosen)
            if not any(dominates(x, found) for x in out):
                out.append(found)
            return
        while i < len(sizes) and (sizes[i] > need or not reach[i + 1] >> need & 1 and not reach[i] >> need & 1):
            i += 1
        if i == len(sizes) or not reach[i] >> need & 1:
            return
        for k in range(min(counts[sizes[i]], need // sizes[i]), -1, -1):
            if reach[i + 1] >> (need - k * sizes[i]) & 1:
                walk(i + 1, need - k * sizes[i], [*chosen, *[sizes[i]] * k])

    for need in range(rest, 0, -1):
        if reach[0] >> need & 1:
            walk(0, need, [])
            if over():
                break
    return out or [(sizes[0],)]


Pattern = tuple[tuple[int, ...], int]


def _times(filling: tuple[int, ...], counts: dict[int, int]) -> int:
    """How often the counts allow a filling."""
    return min(counts[x] // filling.count(x) for x in set(filling))


def plan(counts: dict[int, int], capacity: int, node_budget: int | None = 3000, width: int | None = 3, tries: int | None = 4000) -> list[Pattern]:
    """(lengths of a bin, times) so that every piece has a slot, in as few bins as the search finds.

    A filling is applied as often as the counts allow; an exhaustive search
    (``node_budget``, ``width`` and ``tries`` None) also tries it once only.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    bound = lower_bound(counts, capacity)
    total = sum(k * v for k, v in counts.items())
    best: list[Pattern] = []
    best_bins = -1
    nodes = 0
    # An explicit stack of (fillings not tried yet, counts before, bins before): the depth may pass Python's limit.
    done: list[Pattern] = []
    stack: list[tuple[list[tuple[tuple[int, ...], bool]], dict[int, int], int, int]] = []
    left, bins = dict(counts), 0
    exhaustive = node_budget is None and width is None and tries is None

    def spent() -> bool:
        return node_budget is not None and nodes > node_budget

    def options(now: dict[int, int]) -> list[tuple[tuple[int, ...], bool]]:
        top = max(now)
        rest = dict(now)
        rest[top] -= 1
        found = [(top, *f) for f in fillings(rest, capacity - top, 1 if spent() else width, tries)]
        often = [f for f in found if _times(f, now) > 1] if exhaustive else []
        return [*((f, True) for f in often[::-1]), *((f, False) for f in found[::-1])]

    if left:
        stack.append((options(left), left, 0, total))
    while stack:
        todo, left, bins, mass = stack[-1]
        del done[len(stack) - 1 :]
        if not todo or (best_bins >= 0 and (spent() or best_bins == bound)):
            stack.pop()
            continue
        chosen, once = todo.pop()
        nodes += 1
        times = 1 if once else _times(chosen, left)
        now = dict(left)
        for x in chosen:
            now[x] -= times
        now = {x: c for x, c in now.items() if c}
        done.append((chosen, times))
        mass -= sum(chosen) * times
        bins += times
        if not now:
            if best_bins < 0 or bins < best_bins:
                best, best_bins = list(done), bins
            continue
        if best_bins >= 0 and bins + -(-mass // capacity) >= best_bins:
            continue  # even without more waste it is no better
        stack.append((options(now), now, bins, mass))
    return best


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): rank r of that length is in the row with the largest first rank up to r."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((ranks.get(x, 0), sequence, offset))
            ranks[x] = ranks.get(x, 0) + times
            offset += x
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def place(parts: DataFrame, capacity: int = 1024, node_budget: int | None = 3000, width: int | None = 3, tries: int | None = 4000) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to ``capacity``. ``parts`` must be stored, as it is read twice.

    A full piece needs no rank: its sequence_id is negative and comes from its place in the stored table.
    """
    from pyspark.sql.types import LongType, StructType

    spark = parts.sparkSession
    names = parts.columns
    whole = parts.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts = parts.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    buckets = max(partitions(spark), sum(histogram.values()) // PER_BUCKET)
    dealt = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counted = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    where = slots(plan(histogram, capacity, node_budget, width, tries))
    before = counted.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order))).join(before, ["length", "_bucket"])
    at = ranked.select(*names, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))
    sent = spark.sparkContext.broadcast(where)  # at most `capacity` slots a pattern and a pattern for each length that runs out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                table = sent.value[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = StructType([f for f in at.schema.fields if f.name != "_rank"]).add("sequence_id", LongType()).add("offset", LongType())
    return whole.unionByName(at.mapInArrow(run, schema))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, node_budget: int | None = 3000, width: int | None = 3, tries: int | None = 4000, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it."""
    parts = store(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return place(parts, capacity, node_budget, width, tries)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences: (sequence_id, ids). ``packed`` must hold ids; a sequence has at most ``capacity`` of them."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
