"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as lower-case words joined by single blanks.
With a budget of k edits, an item is split into k + 1 pieces: any passage within
k edits holds one of them unchanged at a shift of at most k.  An Aho-Corasick
automaton finds the pieces, Myers' bit-parallel distance verifies the window
that a hit points to.

The items travel to the tasks in blocks of at most ``block_chars`` characters,
whatever their number; each block is one pass over the documents.

Defined results: null or empty texts and items match nothing; texts may be of any
length; an item shorter than ``min_chars`` (normalised) must stand in the document
unchanged, between word boundaries; every passage that holds an item is a row, and
the rows of an item do not overlap (the best, then first, of overlapping ones
counts); repeated items and documents are each reported; spans are positions in
the normalised text; empty tables give empty tables; other columns, whatever their
names, do not matter to ``matches`` and are kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

SCHEMA = "doc_id long, item_id long, distance int, item_chars int, start long, end long"
RATE = 0.08
MIN_CHARS = 40
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(m: int, rate: float, min_chars: int = MIN_CHARS) -> int:
    """Edits allowed to an item of m characters."""
    return max(1, int(m * rate)) if m >= min_chars else 0


def split(m: int, parts: int) -> list[tuple[int, int]]:
    """[start, end) of ``parts`` pieces of m characters, as even as can be."""
    return [(m * i // parts, m * (i + 1) // parts) for i in range(parts)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of ``text``, and the first place where one with it ends."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for i, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        up = (minus << 1 & full) | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best:
            best, where = score, i
    return best, where


class Block:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items = items
        self.budgets = [budget(len(t), rate, min_chars) for _, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(items):
            if self.budgets[n]:
                for a, b in split(len(t), self.budgets[n] + 1):
                    pieces.setdefault(t[a:b], []).append((n, a))
            else:
                pieces.setdefault(f" {t} ", []).append((n, -1))
        self.auto = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, characters, start, end) of every passage with an item within its budget."""
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.auto.iter(f" {text} "):
            for n, a in where:
                starts.setdefault(n, set()).add(end - size - a)
        out = []
        for n, own in starts.items():
            item_id, t = self.items[n]
            m, k = len(t), self.budgets[n]
            if not k:
                out += [(item_id, 0, m, s, s + m) for s in apart(sorted(own), m)]
                continue
            windows: list[list[int]] = []
            for s in sorted(own):  # hits whose windows overlap are searched together
                lo, hi = max(0, s - k), min(len(text), s + m + k)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(hi, windows[-1][1])
                elif hi > lo:
                    windows.append([lo, hi])
            while windows:
                lo, hi = windows.pop()
                found = self._best(n, text, lo, hi)
                if found:
                    d, a, b = found
                    out.append((item_id, d, m, a, b))
                    windows += [[x, y] for x, y in ((lo, a), (b, hi)) if y - x >= m - k]
        return sorted(out, key=lambda x: (x[3], x[4]))

    def _best(self, n: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        t, k = self.items[n][1], self.budgets[n]
        if n not in self.masks:
            self.masks[n] = masks(t), masks(t[::-1])
        there, back = self.masks[n]
        d, e = myers(there, len(t), text[lo:hi])
        if d > k:
            return None
        # The start: the same match read backwards from its end.
        _, size = myers(back, len(t), text[max(lo, lo + e - len(t) - k) : lo + e][::-1])
        return d, lo + e - size, lo + e


def apart(starts: list[int], size: int) -> list[int]:
    """Those starts whose ranges of ``size`` do not overlap an earlier kept one."""
    out: list[int] = []
    for s in starts:
        if not out or s >= out[-1] + size:
            out.append(s)
    return out


def blocks(items: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, block by block; never more than a block and one partition of items is on the driver."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        t = normal(r["t"])
        if not t:
            continue
        if held and size + len(t) > block_chars:
            yield held
            held, size = [], 0
        held.append((r["i"], t))
        size += len(t)
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, ...) for every passage that holds an item within its budget of edits."""
    spark = docs.sparkSession
    source = texts(docs, id_col, text_col)

    def one(part: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)  # at most block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, rate, min_chars)
            for batch in batches:
                rows = [(doc, *x) for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in block.find(normal(raw.decode("utf-8", "replace")))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "item_chars", "start", "end"])

        return source.mapInArrow(run, SCHEMA)

    parts = [one(x) for x in blocks(items, block_chars, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = 4 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; rows stay where they are, so nothing is shuffled."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)

    def one(rest: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)  # at most block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not (x and block.find(normal(x))) for x in batch.column(at).to_pylist()], pa.bool_()))

        return rest.mapInArrow(run, docs.schema)

    return reduce(one, blocks(items, block_chars, item_col, item_text_col), docs)
