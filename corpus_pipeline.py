"""From raw documents to packed training sequences.

Language identification, near-duplicate removal, benchmark decontamination,
sanitisation of personal data and packing, each over all that the stage before
it kept.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, minhash, packing, pii
from sparkloom.llm.common import drop_stored, read, store, unused
from sparkloom.llm.queries import id_crc, tokenizer
from sparkloom.storage import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter (language ``und``); a missing lang is filled with the prediction, no other column changes."""
    names = docs.columns
    profiles = language.learn(docs, id_crc() % 4 != 2)
    pred, score = unused(docs, "_lang_pred"), unused(docs, "_lang_score")
    found = language.identify(docs, profiles, pred_col=pred, score_col=score)
    return found.where(F.col(pred) != language.UND).withColumn("lang", F.coalesce("lang", pred)).select(*names)


def row_key(docs: DataFrame) -> Column:
    """A number of 64 bits for each row by doc_id and text; rows that differ in one of them never share it.

    Among billions of rows some hashes meet by chance: rows are counted by hash and by
    a name of 128 bits, and hashes that several names share are drawn again.
    """
    none = F.concat(F.col("doc_id").isNull().cast("string"), F.col("text").isNull().cast("string"), F.lit(":"))
    name = F.md5(F.concat(none.cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), F.coalesce("text", F.lit("")).cast("binary")))
    named = store(docs.select(name.alias("name")).distinct(), "row-names")
    key, key_of = F.xxhash64("name"), F.xxhash64(name)
    for seed in itertools.count(1):
        met = named.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key").collect()  # n * n / 2**65 rows are to be expected
        if not met:
            return key_of
        again = [r.key for r in met]
        key, key_of = (F.when(k.isin(again), F.xxhash64(x, F.lit(seed))).otherwise(k) for k, x in ((key, F.col("name")), (key_of, name)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest doc_id stays, null last; of rows equal in doc_id and text, one.

    Rows are told apart by id and text, so a missing or repeated doc_id neither
    hides a copy nor takes other rows along.
    """
    name, key = unused(docs, "_key"), row_key(docs)
    found = minhash.near_duplicates(docs.select(key.alias("_key"), "text"), "_key")
    linked = store(found.where(~F.col("kept")).select(F.col("doc_id").alias("_key"), "component_id").distinct(), "linked")
    first = linked.select(F.col("component_id").alias("_key"), "component_id").distinct()  # the smallest key of each group
    ids = docs.select(key.alias("_key"), "doc_id").distinct()
    members = store(linked.unionByName(first).join(ids, "_key"), "named")
    stay = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key"))["_key"].alias("_key"))
    gone = members.select("_key").join(stay, "_key", "left_anti")
    rest = docs.withColumn(name, key).join(gone.withColumnRenamed("_key", name), name, "left_anti")
    return rest.dropDuplicates([name]).drop(name)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language_id), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_free), ("pii", sanitised), ("packing", packed)]
#: The stages tokenise and compare edit distances, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder, read again, and deleted with the other stored tables."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        table = scratch(f"pipeline-{name}")
        docs = store(stage(spark, docs, sf_dir), table)
        if before:
            drop_stored(before)
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
