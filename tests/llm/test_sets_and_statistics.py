"""Source divergence, whitening and the prefix join against brute force, and their edge cases."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence, prefix_join, whitening

def clashing(df):
    return df.withColumns({c: F.lit(c) for c in ("term", "value", "set", "key", "rank", "x", "block", "n_shingles", "component")})


# ---------------------------------------------------------------- divergence


def divergences(rows, min_docs, top):
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))) for text, lang, source in rows]
    in_docs, counts = collections.Counter(), collections.Counter()
    for lang, source, words in rows:
        in_docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(w for (g, w), n in in_docs.items() if g == lang and n >= min_docs)
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def p(of):
            total = sum(of[w] for w in kept)
            return {w: 1 + 10**9 * (of[w] + 5) // (total + 5 * len(kept)) for w in kept}

        each = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        ps = {s: p(each[s]) for s in sources}
        q = p({w: sum(each[s][w] for s in sources) for w in kept})
        for s in sources:
            pairs = [(t, sum(abs(ps[s][w] - ps[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, ps[s][w] - q[w]) for w in kept if each[s][w] and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "été", "naïve", "ＡＢ", "🎉", "Straße"]
    rows = []
    for k in range(300):
        text = " ".join(rng.choice(words[: rng.choice((5, 40, 126))]).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "b", "ｃ", None, f"s{k % 9}"])))
    rows += [(None, "en", "only null"), ("", "none", "x"), ("123 !!", "none", "y"), (None, None, None), ("one two", "single", "s"), ("x" * 100000 + " wa", "en", "a"), ("wa " * 50000, "en", "b")]
    return rows + rows[:20]


@pytest.mark.parametrize("tile, bucket, slice_", [(128, 4096, 4 << 20), (3, 16, 2000)])
def test_divergence(spark, monkeypatch, tile, bucket, slice_):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    rows = odd_rows()
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(4)
    found = sorted(tuple(r) for r in divergence.divergence(df, min_docs=4, top=7).collect())
    assert found == divergences(rows, 4, 7)
    assert any(r[2] == "pair" and r[4] == 0 for r in found) and any(r[2] == "term" and r[5] == 7 for r in found)


def test_divergence_runs_in_small_slices(monkeypatch):
    """What a task holds is joined and given out in parts; the counts do not change."""
    import pyarrow as pa

    rows = [(g or "", s or "", (t or "").encode()) for t, g, s in odd_rows()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "source", "text"])
    whole = collections.Counter()
    for part in (batch, *divergence.slices(batch, 500)):
        sign = 1 if part.num_rows == batch.num_rows else -1
        for r in divergence.local_runs(part).to_pylist():
            for c in ("docs", "n"):
                whole[r["lang"], r["source"], r["term"], c] += sign * r[c]
    assert not any(whole.values())


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_probability_is_exact():
    rng = random.Random(1)
    counts = [rng.choice((0, 1, 10**6, 10**15)) + rng.randint(0, 99) for _ in range(500)]
    totals = [c + 5 + rng.randint(0, 7 * 10**15) for c in counts]
    found = divergence.probability(np.array(counts), np.array(totals))
    assert found.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals, strict=True)]


# ----------------------------------------------------------------- whitening


def vectors():
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 7)) @ np.diag([3, 1.5, 1, 0.6, 0.3, 0.2, 0.1]) @ np.linalg.qr(rng.normal(size=(7, 7)))[0] + 4
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]  # one vector holds a third of the rows
    rows += [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] * 7), (903, [float("inf")] + [0.0] * 6), (904, []), (905, [1.0, 2.0]), (None, rows[1][1]), (7, rows[2][1]), (906, [-0.0] * 7)]
    return rows


def test_whitening(spark):
    rows = vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)
    found = whitening.whiten(df).collect()
    good = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and len(v) == 7 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) for j in range(7)] for i in range(7)]
    v = np.array([[float(Fraction(c, n**3)) for c in r] for r in exact])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(found) == 4 * len(good)
    by = collections.defaultdict(list)
    for r in found:
        by[r.component].append(r)
        assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - e[r.component - 1] / v.trace()) < 1e-13
    for k, own in by.items():
        expected = sorted((-1 if i is None else i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), float(np.dot([c - t / n for c, t in zip(x, s, strict=True)], u[:, k - 1])) / e[k - 1] ** 0.5) for i, x in good)
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in own)
        sign = 1 if got[0][2] * expected[0][2] > 0 else -1
        for a, b in zip(sorted((i, d, sign * w) for i, d, w in got), expected, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9


def test_compensated_covariance_is_exact_to_double_double():
    """Sums that doubles lose: a large mean and a tiny spread."""
    rng = random.Random(2)
    x = np.array([[10**12 + rng.randint(-3, 3), rng.randint(-(10**15), 10**15)] for _ in range(5000)])
    n = len(x)
    s = [int(c) for c in x.sum(axis=0)]
    mean = whitening.parts([Fraction(c, n) for c in s])
    high, low = np.zeros((2, 2)), np.zeros((2, 2))
    for at in range(0, n, whitening.BLOCK):
        for p in whitening.products(*whitening.centred(x[at : at + whitening.BLOCK], mean)):
            high, low = whitening.added(high, low, p)
    for i in range(2):
        for j in range(2):
            exact = Fraction(sum((n * int(a[i]) - s[i]) * (n * int(a[j]) - s[j]) for a in x), n * n)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction((high[i, i] * high[j, j]) ** 0.5 * 2.0**-90)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]])
def test_whitening_without_variance(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.collect() == [] and found.columns[0] == "vec_id"


def test_whitening_keeps_components_with_variance_only(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)] + [(99, [1e18, 0.0, 0.0])][:0]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in found} == {1} and abs(sum(r.whitened for r in found)) < 1e-9 and found[0].explained == pytest.approx(1)


# --------------------------------------------------------------- prefix join


def word_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows):
    """{(doc_id, text): (n, component)} by comparing all pairs."""
    sets = [(i, word_sets(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if (x and y and 100 * len(x & y) >= 80 * len(x | y)) or (sets[a][0] is not None and sets[a][0] == sets[b][0] and x and y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, len(s), (least.get(root(k)) if s else i)) for k, (i, s) in enumerate(sets))


def similar_texts():
    rng = random.Random(11)
    word = lambda: f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 999)}"
    passages = [[word() for _ in range(60)] for _ in range(3)]
    rows, base = [], None
    for i in range(260):
        kind = rng.random()
        if base is None or kind < 0.2:
            base = [word() for _ in range(rng.choice((3, 5, 6, 9, 30, 120)))]
            text = base
        elif kind < 0.65:  # near copies at all distances from the threshold
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = word()
        elif kind < 0.8:
            text = [word() for _ in range(rng.randint(5, 60))] + rng.choice(passages)
        elif kind < 0.9:  # little but shared passages
            text = sum(rng.sample(passages, rng.randint(1, 3)), []) + [word() for _ in range(rng.randint(0, 12))]
        else:
            text = base
        rows.append((i, " ".join(w.upper() if rng.random() < 0.02 else w for w in text)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a"), (1004, "A"), (1005, "a b c d"), (1006, "a b c d e"), (1007, "word " * 30000), (1007, "word " * 30000), (None, rows[0][1]), (None, "no id but words of its own here"), (5, rows[9][1] + " tail"), (1008, "É É É É É É"), (1009, " ".join(word() for _ in range(9000)))]
    return rows


@pytest.mark.parametrize("block", [512, 6])
def test_prefix_join(spark, monkeypatch, block):
    """With a small BLOCK the units go to checks by shared shingle and by pairs of blocks."""
    monkeypatch.setattr(prefix_join, "BLOCK", block)
    rows = similar_texts()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(6)
    found = prefix_join.similar_documents(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert collections.Counter(tuple(r) for r in found.collect()) == components(rows)


def test_prefix_join_of_nothing(spark):
    assert prefix_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in prefix_join.similar_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_prefix_length_keeps_every_link():
    for n in range(1, 200):
        for m in range(n, 300):
            common = -(-80 * (n + m) // 180)
            if 100 * common >= 80 * (n + m - common) and common <= n:
                p, q = prefix_join.prefix_length(np.array([n, m]))
                assert n - common < p and m - common < q
                assert math.floor(math.log(m) / math.log(1.26)) - math.floor(math.log(n) / math.log(1.26)) <= 1
