"""Token counts by overlap resynchronisation.

A text of at most ``chunk_chars`` characters is encoded at once, word by word
(``words``).  A longer one is encoded in overlapping chunks with offsets.  Two neighbours are spliced at a
white-space character of their overlap before which both have the same token
ends since the white space before it.  No token of a word tokenizer spans white
space and its rules never look back, so all tokens after such a place are the
same in either chunk.  If the overlap holds no such place, it is doubled, up to
the whole text.

Defined results: a null or empty text has no tokens; equal texts have equal
counts; other columns and repeated rows do not matter; an empty table gives an
empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .words import load, words_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_SPACE = " \t\n\r"


def _boundaries(text: str, lo: int, hi: int) -> list[int]:
    """White space in (lo, hi) with a visible character before it and no combining mark after it."""
    return [p for p in range(lo + 1, hi - 1) if text[p] in _SPACE and text[p - 1] not in _SPACE and not unicodedata.combining(text[p + 1])]


def _agreed(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], lo: int, hi: int) -> int | None:
    """The last boundary before which both chunks have the same tokens since the boundary before it."""
    cuts = _boundaries(text, lo, hi)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=False):
        mine = [x for x in left if a <= x[0] and x[1] <= b]
        if mine and mine == [x for x in right if a <= x[0] and x[1] <= b] and any(x[1] == b for x in mine):
            return b
    return None


def count_long(tok, text: str, chunk_chars: int, overlap: int) -> int:
    """Tokens of one text, never encoding more than a widened chunk at a time."""
    total, keep_from, start = 0, 0, 0
    end = min(len(text), chunk_chars)
    tokens = [tuple(x) for x in tok.encode(text[:end], add_special_tokens=False).offsets]
    while end < len(text):
        wide = overlap
        while True:
            new_start = max(start, end - wide)
            new_end = min(len(text), end + max(chunk_chars, wide) - overlap)
            part = [(a + new_start, b + new_start) for a, b in tok.encode(text[new_start:new_end], add_special_tokens=False).offsets]
            cut = _agreed(text, tokens, part, max(new_start, keep_from), end)
            if cut is not None:
                break
            if new_start == start:  # all of the chunk is in the overlap: take one chunk that reaches further instead
                end = min(len(text), end + chunk_chars + wide)
                tokens = [(a + start, b + start) for a, b in tok.encode(text[start:end], add_special_tokens=False).offsets]
                tokens = [x for x in tokens if x[0] >= keep_from]
                if end == len(text):
                    return total + len(tokens)
            wide *= 2
        total += sum(1 for x in tokens if x[1] <= cut)
        tokens = [x for x in part if x[0] >= cut]
        start, end, keep_from = new_start, new_end, cut
    return total + len(tokens)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk_chars: int = 16384, overlap: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its UTF-8 bytes, its tokens, and whether they exceed ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, words = load(tokenizer_path), words_of(tokenizer_path)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            ids = batch.column(0)
            for at in range(0, len(raw), 512):
                part = raw[at : at + 512]
                known = dict.fromkeys(part, 0)
                short = []
                for x in known:
                    text = x.decode("utf-8", "replace")
                    if len(text) > chunk_chars:
                        known[x] = count_long(tok, text, chunk_chars, overlap)
                    else:
                        short.append((x, text))
                for (x, _), found in zip(short, words.encode([t for _, t in short]), strict=True):
                    known[x] = len(found) // 4
                n = [known[x] for x in part]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)).cast(pa.int64()), pa.array(map(len, part), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
