"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, language, media, minhash, packing, pii, ppm, prefix_join, repeats, token_counts, warc, whitening
from .common import read, store
from .oracles import ORACLES


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, ...): every benchmark item within its budget of edits in a document."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; null texts are their end token."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc() % 4 == 2
    profiles = language.learn(docs, ~held_out)
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are stored, and the digests and features come from what is read back."""
    return media.digests(store(media.media(read(spark, sf_dir, "documents")), "media", "zstd"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and runs that repeat something earlier, per document."""
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), keep=False).drop("kept")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data and of terms that disclose it."""
    return pii.report(pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return ppm.score(read(spark, sf_dir, "documents"), id_crc() % 5 == 1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived records for each page; the block as its digest and size."""
    found = warc.derivatives(read(spark, sf_dir, "pages"))
    return found.select(*[c for c in found.columns if c not in ("headers", "block")], F.crc32(F.col("headers").cast("binary")).alias("headers_crc32"), F.length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each pair of sources of a language differs, and the terms that a source uses more than its language."""
    return divergence.divergence(read(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the first four axes of its table, each scaled to variance one."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of similarity 0.8 or more."""
    return prefix_join.similar_documents(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_decontaminate, op2_packing, op3_language, op4_media, op5_repeats, op6_near_duplicates, op7_pii, op8_ppm, op9_warc, op10_token_counts, op11_divergence, op12_whitening, op13_prefix_join]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
