"""Language identification by rank-order profiles.

A text is lower-cased (NFC), everything but letters becomes a single space, and
the words, with one blank on either side, give n-grams of one to three
characters.  A language's profile is the ``size`` most frequent n-grams of its
training texts; a document's are its own.  The out-of-place distance adds how far
each of the document's n-grams stands from its place in the profile, ``size`` if
it is missing.  The nearest profile wins, ties by language name.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is everything when there is nothing to learn from; rows without a language
are predicted but not learnt from; texts may be of any length; equal texts have
equal results; n-grams of equal frequency rank by their code points; rows may
repeat; an empty table gives an empty table; other columns are carried, but for
columns named ``lang_pred`` or ``score``, which are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
SIZE = 400
Profiles = dict[str, tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, 21 bits a character; empty if it has no letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[a]
    a = np.where(letter, a, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after each word
    a = a[keep].astype(np.int64)
    if not len(a):
        return a
    a = np.concatenate(([32], a, [32])) if a[-1] != 32 else np.concatenate(([32], a))
    pairs = a[:-1] << 21 | a[1:]
    triples = pairs[:-1] << 21 | a[2:]
    return np.concatenate((a[a != 32], pairs, triples[a[1:-1] != 32]))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:size]]


def learn(docs: DataFrame, train: Column, size: int = SIZE, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Profiles from all rows for which ``train`` holds and the language is not null: at most ``size`` n-grams a language."""
    source = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = np.unique(grams(text), return_counts=True)
                held.setdefault(lang, []).append((codes, n))
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sizes[lang] > 1 << 20:  # merge what has gathered
                    held[lang] = [merged(lang)]
                    sizes[lang] = len(held[lang][0][0]) // 2
        for lang in held:
            codes, n = merged(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counts = source.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "code", "rank").collect()  # `size` rows a language
    out: Profiles = {}
    for lang in sorted({r["lang"] for r in top}):
        own = sorted((r["code"], r["rank"] - 1) for r in top if r["lang"] == lang)
        out[lang] = (np.array([c for c, _ in own], np.int64), np.array([k for _, k in own], np.int64))
    return out


def distance(own: np.ndarray, profile: tuple[np.ndarray, np.ndarray], size: int) -> int:
    codes, ranks = profile
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    return int(np.where(codes[at] == own, np.abs(ranks[at] - np.arange(len(own))), size).sum())


def classify(text: str | None, profiles: Profiles, size: int = SIZE) -> tuple[str, float]:
    own = ranked(grams(text), size) if text else np.zeros(0, np.int64)
    if not len(own) or not profiles:
        return UND, 0.0
    far, lang = min((distance(own, p, size), name) for name, p in profiles.items())
    return lang, 1.0 - far / (len(own) * size)


def identify(docs: DataFrame, profiles: Profiles, size: int = SIZE, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language and its score added; profiles hold ``size`` n-grams a language, so they go with the task.

    Columns with the names of the two, in any case of letters, are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names = docs.columns
    at = names.index(text_col)
    kept = [n for n in names if n.lower() not in (pred_col.lower(), score_col.lower())]
    schema = StructType([docs.schema[n] for n in kept] + [StructField(pred_col, StringType()), StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(x, profiles, size) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(n)) for n in kept), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, pred_col, score_col]
            )

    return docs.mapInArrow(run, schema)
