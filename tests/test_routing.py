"""Scores of projects against a plain version, and how often their texts are split."""

from collections import Counter, defaultdict

from sparkloom.operators import routing

PROJECTS = [("a", "alpha beta gamma alpha"), ("a", "alpha delta"), ("a", "alpha"), ("b", "beta gamma"), ("b", "gamma"), ("c", "omega beta"), (None, "alpha omega"), ("d", None), ("d", "")]
ROWS = [(1, "alpha beta"), (2, "gamma gamma omega"), (3, "nothing known"), (4, None), (5, "delta"), (None, "beta alpha")]


def tables(spark):
    return spark.createDataFrame(ROWS, "id long, text string"), spark.createDataFrame(PROJECTS, "project string, text string")


def test_scores_equal_the_plain_version(spark):
    held = defaultdict(Counter)
    for project, text in PROJECTS:
        for term in set((text or "").split()):
            held[term][project] += 1
    expected = {}
    for i, text in ROWS:
        score = Counter()
        for term in set((text or "").split()):
            for project, n in held.get(term, {}).items():
                score[project] += {1: 0.4, 2: 0.7}.get(n, 1.0) / len(held[term])
        best = sorted(score.items(), key=lambda s: (-round(s[1], 6), s[0] is not None, s[0] or ""))
        if best:
            second = best[1][1] if best[1:] else 0.0
            expected[i] = (best[0][0], round(best[0][1], 6), best[0][1] >= 0.3 and best[0][1] >= 1.2 * second)
    found = routing.scores(*tables(spark), min_score=0.3, margin=1.2)
    assert {r.id: (r.project, r.score, r.confident) for r in found.collect()} == expected and set(expected) == {1, 2, 5, None}


def test_each_text_is_split_once(spark):
    plan = routing.scores(*tables(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and plan.count("Generate explode(") == 2
    assert not any("Filter" in line and "regexp_extract_all" in line for line in plan.splitlines())
