"""A stored inverted index and search over it by word beginnings.

``build`` writes the postings, each file in order of its terms, the dictionary and one row of
statistics; a search reads the statistics and those parts of the postings whose range of
terms a word can begin, and no document.  Only what is as large as the queries goes to every
task: the dictionary grows with the documents, so terms are expanded where their postings are
read.  Letters lose their accents, so that a word is found without them.

Defined results: null and empty texts count as documents without words; of an id on several
rows the words are those of all of them; a query without words finds nothing.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import store
from .retrieval import scored, top

_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def plain(text: Column) -> Column:
    """Lower case without accents, composed or combining."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "".join(a for a, _ in _PAIRS) + _MARKS, "".join(b for _, b in _PAIRS)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: For so many words the ranges of their terms are pushed into the scan of the postings.
PUSHED = 64


@dataclass(frozen=True)
class Index:
    """postings (id, term, tf, dl), terms (term, df), stats (n_docs, avg_dl): one row; a document without words has the term ''."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of (id, text), stored. Texts are shuffled, once; words and counts of a document stay in its task."""
    split = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id").select("id", words(F.col("text")).alias("w"))
    one = split.select("id", F.size("w").cast("long").alias("dl"), F.explode(F.when(F.size("w") > 0, F.col("w")).otherwise(F.array(F.lit("")))).alias("term"))
    counted = one.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return of_postings(store(counted.sortWithinPartitions("term"), "postings", "zstd"))


def of_postings(postings: DataFrame) -> Index:
    """The index of stored postings: their dictionary and statistics are stored too."""
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = postings.agg(F.countDistinct("id").alias("n_docs"), F.sum(F.when(F.col("term") != "", F.col("tf")).otherwise(0)).alias("_all"))
    stats = stats.select("n_docs", F.try_divide("_all", "n_docs").alias("avg_dl"))
    return Index(postings, store(terms.repartitionByRange("term").sortWithinPartitions("term"), "terms"), store(stats, "stats"))


def expand(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """R2: the rows of ``terms`` (term, ...) once for each word that begins their term. Equal beginnings are joined, cut at the lengths that the words have."""
    sizes = asked.agg(F.collect_set(F.length("word")).alias("sizes"))  # one row, an entry a length
    cuts = terms.crossJoin(F.broadcast(sizes)).withColumn("_n", F.explode("sizes")).where(F.col("_n") <= F.length("term"))
    begun = cuts.withColumn("word", F.substring(F.col("term"), F.lit(1), F.col("_n"))).drop("sizes", "_n")
    return begun.join(F.broadcast(asked.select("word").distinct()), "word")  # a row a word of the queries


def _least(asked: DataFrame) -> DataFrame:
    """(word): the words that no other word begins; a term that begins with any word begins with just one of these."""
    own = asked.select(F.col("word").alias("term"))
    return expand(own.distinct(), asked).groupBy(F.col("term").alias("word")).agg(F.count("*").alias("n")).where("n = 1").select("word")


def _ranges(asked: DataFrame) -> Column:
    """What a term must satisfy to begin with one of a few words, as ranges that a scan of sorted files can skip by."""
    found = [r.word for r in asked.select("word").distinct().limit(PUSHED + 1).collect()]
    if not found or len(found) > PUSHED:
        return F.lit(True)
    out = F.lit(False)
    for w in found:
        out = out | ((F.col("term") >= w) & (F.col("term") <= w + chr(0x10FFFF)))
    return out


def search(index: Index, queries: DataFrame, limit: int) -> DataFrame:
    """Documents with all words of a query first, then those with some, each by BM25; a word stands for all terms that begin with it."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))
    size = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    begun = expand(index.postings.where(_ranges(asked)), _least(asked)).select("id", "term", "tf", "dl").repartition("id")  # a row a posting, however many words begin it
    hits = expand(begun, asked).groupBy("word", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    df = hits.groupBy("word").agg(F.count(F.col("tf") + F.col("dl")).alias("df"))  # never null; reads what the scores read, so both share one shuffle
    found = scored(hits, df, index.stats, asked, "word")
    ranked = found.join(F.broadcast(size), "query_id").withColumn("pass", F.when(F.col("matched") == F.col("n"), 0).otherwise(1).cast("long"))
    return top(ranked, limit, F.col("pass"), F.desc("score"), F.col("id")).select("query_id", "id", "score", "pass", F.col("rank").cast("long").alias("rank"))


def having(index: Index, word: str) -> DataFrame:
    """The ids of the documents with a word."""
    return index.postings.where(F.col("term") == plain(F.lit(word))).select("id")
