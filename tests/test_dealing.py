"""Steps whose rows must not grow faster than their input, by their plans and on small tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import index, retrieval

DOCS = [(1, "the cat and the dog"), (1, "the bird"), (2, "dog dog"), (3, None), (None, "cat")]


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in line and "ENSURE_REQUIREMENTS" in line]


@pytest.mark.parametrize("stored", [False, True])
def test_scores_of_a_document_stay_in_its_task(spark, stored):
    """pairs of query and document are not shuffled."""
    docs = spark.createDataFrame(DOCS, "id int, text string")
    asked = spark.createDataFrame([(1, "cat dog"), (2, "the dog"), (3, "fish")], "query_id int, query string")
    if stored:
        out = index.search(index.build(docs, "id", "text"), asked, 10)
        want = {(1, 1, 0), (1, 2, 1), (1, None, 1), (2, 1, 0), (2, 2, 1)}
        assert {(r.query_id, r.id, r["pass"]) for r in out.collect()} == want
    else:
        out = retrieval.bm25(docs, asked, "id", "text")
        assert {(r.query_id, r.id, r.matched) for r in out.collect()} == {(1, 1, 2), (1, 2, 1), (1, None, 1), (2, 1, 2), (2, 2, 1)}
    assert not [line for line in shuffles(out) if "hashpartitioning(query_id" in line and ", id#" in line]


def test_names_of_many_meanings_meet_their_counts_only(spark):
    """the meanings of a name are joined where there are at most three."""
    from sparkloom.operators import names

    symbols = spark.createDataFrame([(f"s{p}", "Common", f"q{p}-{i}", "function") for p in range(2) for i in range(50)] + [("s0", "Pair", "x", "function"), ("s1", "Pair", "y", "function"), ("s0", "Single", "z", "function")], "path string, name string, qualname string, kind string")
    aliases = spark.createDataFrame([(f"c{i}", "x", to, None) for i in range(20) for to in ("s0", "s1")], "path string, alias string, to_path string, symbol string")
    asked = spark.createDataFrame([(f"c{i}", n) for i in range(21) for n in ("Common", "Pair", "Single")], "path string, name string")
    picked = names._pick(asked, names._by_name(symbols, names.CALLABLE), aliases, ["path", "name"], False)
    assert picked.where("name = 'Common'").isEmpty() and picked.count() == 20 * 3 + 2 + 1
    got = {(r.path, r.name, r.to_path, r.to_name, round(r.weight, 6)) for r in names.references(asked, symbols, aliases).collect()}
    want = {(f"c{i}", "Pair", p, q, 0.3) for i in range(20) for p, q in (("s0", "x"), ("s1", "y"))}
    assert got == want | {(f"c{i}", "Single", "s0", "z", 0.6) for i in range(20)} | {("c20", "Single", "s0", "z", 0.3)}


def test_best_place_counts_what_stands_before(spark):
    """the rank of the best expected hit without a ranking of all hits."""
    from sparkloom.operators import evaluation

    hits = spark.createDataFrame([(1, 10, 3.0), (1, 11, 3.0), (1, 12, 5.0), (1, 13, 1.0), (2, 10, 1.0), (3, 7, 2.0)], "query_id int, id int, score double")
    expected = spark.createDataFrame([(1, 11), (1, 13), (3, 7), (4, 1)], "query_id int, id int")
    out = evaluation.best_place(hits, expected)
    assert {tuple(r) for r in out.collect()} == {(1, 11, 3), (2, None, None), (3, 7, 1)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_both_directions_are_summed_once(spark):
    """F8: one aggregation over pairs; loops, null ends and edges in both directions."""
    from sparkloom.operators import graph

    edges = [(1, 2, "calls", 1.0), (2, 1, "calls", 2.0), (3, 3, "contains", 1.0), (None, 4, "depends", None), (4, None, "depends", 1.0), (5, 6, "other", 1.0)]
    out = graph.structural(spark.createDataFrame(edges, "src int, dst int, kind string, weight double"))
    got = {(r.src, r.dst): round(r.weight, 9) for r in out.collect()}
    assert out.count() == len(got) and got == {(1, 2): 1.16, (2, 1): 2.08, (3, 3): 0.75, (None, 4): 0.324, (4, None): 0.324}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("HashAggregate")
