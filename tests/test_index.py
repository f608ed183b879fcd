"""The stored index: word beginnings, accents, ranges, statistics and edge cases."""

import math

from pyspark.sql import functions as F

from sparkloom.operators import index

DOCS = [(1, "Café au lait"), (2, "cafeteria menu"), (3, "Café noir, CAFÉ"), (4, None), (5, " .. "), (6, "lait lait lait"), (6, "more of six"), (7, "zebra")]


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id int, query string")


def found(spark, built, *queries, limit=10):
    out = {}
    for r in index.search(built, asked(spark, *queries), limit).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r["pass"]))
    return out


def test_search_by_beginnings_and_without_accents(spark):
    built = index.build(spark.createDataFrame(DOCS, "id int, text string"), "id", "text")
    got = found(spark, built, "cafe", "CAFÉ lait", "six lai", "nothing", "", "zeb")
    assert {i for i, _ in got[1]} == {1, 2, 3} and got[2][0] == (1, 0) and {i for i, p in got[2] if p} == {2, 3, 6}
    assert got[3][0] == (6, 0) and 4 not in got and 5 not in got and got[6] == [(7, 0)]
    assert sorted(r.id for r in index.having(built, "Café").collect()) == [1, 3]
    stats = built.stats.first()
    assert stats.n_docs == 7 and math.isclose(stats.avg_dl, 15 / 7)
    assert {r.term: r.df for r in built.terms.collect()}["cafe"] == 2


def test_many_words_find_the_same_without_pushed_ranges(spark, monkeypatch):
    built = index.build(spark.createDataFrame(DOCS, "id int, text string"), "id", "text")
    with_ranges = found(spark, built, "cafe lait", "menu")
    monkeypatch.setattr(index, "PUSHED", 1)
    assert found(spark, built, "cafe lait", "menu") == with_ranges


def test_an_empty_index(spark):
    built = index.build(spark.createDataFrame([], "id int, text string"), "id", "text")
    assert found(spark, built, "cafe") == {} and index.having(built, "x").collect() == []
    assert built.stats.select(F.col("n_docs")).first()[0] == 0


def test_ranges_reach_the_scan(spark):
    built = index.build(spark.createDataFrame(DOCS, "id int, text string"), "id", "text")
    plan = built.postings.where(index._ranges(asked(spark, "cafe").withColumnRenamed("query", "word")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo" in plan or "GreaterThanOrEqual(term,cafe)" in plan


def test_what_goes_to_every_task_does_not_grow_with_the_documents(spark):
    """the terms that words begin were sent to every task by the driver; they are as many as the documents have."""
    docs = spark.range(40).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.concat(F.lit("b"), (F.col("id") * 3000 + i).cast("string")))).alias("text"))
    built = index.build(docs, "id", "text")
    got = found(spark, built, "b b1 zebra", "b7 b70 b700")
    assert len(got[1]) == 10 and {p for _, p in got[1]} == {1} and {i for i, p in got[2] if not p} == {0, 2, 23}
    assert not [f for f in index.search(built, asked(spark, "b"), 10).inputFiles() if "sparkloom-terms-" in f]
