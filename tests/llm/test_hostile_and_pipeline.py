"""Inputs that mean harm, ids that stand on several texts, clashing names, and the pipeline against a plain version."""

import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language, packing, queries, repeats, warc, words

DATA = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ op5: ids
def removed(rows):
    """Windows of 100 bytes that an earlier text or place has; texts in the order of id and digest, equal rows as one."""
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5((x[1] or "").encode()).digest()))
    first = {}
    for row in order:
        b = (row[1] or "").encode()
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (row, p))
    out = collections.Counter()
    for row in rows:
        b = (row[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (row, p):
                gone[p : p + 100] = True
        out[row[0], len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def test_repeats_where_ids_stand_on_several_texts(spark):
    rand = random.Random(8)
    one, two, three = ("".join(rand.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (5, two + three), (5, two), (None, three), (None, one[50:350]), (None, None), (7, three[:150] + two[:150]), (7, ""), (9, one + one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in ({}, {"hot": 2, "shard": 700}):
        found = repeats.remove_repeats(docs, **settings).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in found) == removed(rows)
    kept = {r.kept_sha256: r.n_removed for r in found if r.doc_id == 5}
    assert 0 in kept.values()  # the first text of the id stays whole


# --------------------------------------------------------------- op9: pages
@pytest.mark.parametrize(
    "body",
    [
        b"<p>&#" + b"9" * 5000 + b"; &#x" + b"f" * 5000 + b"; end</p><a href='/x&#" + b"1" * 5000 + b"'>l</a><title>&#" + b"7" * 5000 + b"</title>",
        b"<p>&#55296; &#xDFFF; &#1114112; &#99999999; &#0; &amp;</p>",
        b"<a href='a\r\nWARC-Type: response'>x</a><title>one\r\ntwo\x85three</title>",
        b"\xff\xfe\x00<\x00p\x00>", b"+2D/YAA- <p>x</p>", b"", b"<" * 20000 + b"&#" * 20000,
    ],
)
@pytest.mark.parametrize("charset", ["utf-8", "utf-7", "unicode_escape", "raw_unicode_escape", "utf-16", "idna", "rot13", "hex", "nonsense", "punycode"])
def test_hostile_pages_give_two_records(body, charset):
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\nX-Odd: a\r\n\tb\r\n\r\n".encode() + body
    found = warc.derive("<urn:uuid:1>\r\nX: y", "http://a/b c\r\nWARC-Type: response\r\n\r\nHTTP/1.1 \x00é", "2024\r\nX: y", block)
    assert [r[0] for r in found] == ["metadata", "conversion"]
    for r in found:
        ((head, body_),) = warc.parse(warc.serialise(r[9], r[10]))
        assert head["WARC-Type"] == r[0] and body_ == r[10] and "X" not in head and len(r[9].split("\r\n")) == 15
        assert head["WARC-Target-URI"] == "http://a/b%20c%0D%0AWARC-Type:%20response%0D%0A%0D%0AHTTP/1.1%20%00é"
        r[10].decode("utf-8")


def test_references_that_are_no_characters():
    assert warc.unescaped("&#65;&#x41;&amp;&#00000065; &#123456789 &lt") == "AA&� � <"
    assert warc.unescaped("&#" + "1" * 5000 + ";") == "�"


def test_warc_files_as_streams():
    record = warc.serialise("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n", b"abc")
    many = b"".join(gzip.compress(record) for _ in range(500))
    assert sum(b == b"abc" for _, b in warc.records(many)) == 500 and len(warc.parse(record * 3)) == 3 and warc.parse(b"") == []
    assert len(warc.parse(gzip.compress(record * 2) + gzip.compress(record))) == 3
    stream = warc.records(many + b"broken")
    assert next(stream)[1] == b"abc"  # read as they come
    for bad in (many[:-9], many + b"\x1f\x8b", gzip.compress(record)[:-1], b"\x1f\x8bxx", b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n", record[:-6], b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\nab"):
        with pytest.raises(ValueError):
            warc.parse(bad)


# ---------------------------------------------------------------- op3: names
def test_language_does_not_touch_other_names(spark):
    docs = spark.createDataFrame([(1, "the house of the night", "en", 42.0, "x")], "doc_id long, text string, lang string, Score double, LANG_PRED string")
    profiles = language.learn(docs, F.lit(True))
    found = language.identify(docs, profiles)
    assert [c.lower() for c in found.columns] == ["doc_id", "text", "lang", "lang_pred", "score"]
    other = language.identify(docs, profiles, pred_col="p", score_col="q").first()
    assert (other.Score, other.LANG_PRED, other.p) == (42.0, "x", "en")


# ------------------------------------------------------------------ pipeline
def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def one_of_each_group(rows):
    """Rows (doc_id, text, ...) without near duplicates: equal rows once, of a group the smallest id, null last; ties as the hash has them, so only one is asked for."""
    names = list(dict.fromkeys((r[0], r[1]) for r in rows))
    sets = [shingle_set(t) for _, t in names]
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, n in enumerate(names):
        groups[root(k)].append(n)
    return list(groups.values())


ODD = [(90001, None, None), (90002, "", "en"), (90003, "12 34 !?", None), (90004, "Hello there, this is all of it.", None), (90004, "Hello there, this is all of it.", None), (None, "Some text that has no id but many words of its own kind.", "en"), (90005, "word " * 3000, None), (90005, "another text under the same id as the one before", "en")]


def test_pipeline_is_its_plain_version(spark):
    """Each stage over what the one before kept, with columns whose names clash, against plain Python over the same rows."""
    import corpus_pipeline

    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = real.unionByName(spark.createDataFrame([(i, t, g, "odd") for i, t, g in ODD], "doc_id long, text string, lang string, source string"))
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit(42.0), "lang_pred": F.lit("mine"), "_key": F.lit("k"), "name": F.lit("n")})
    given = [(r.doc_id, r.text, r.lang) for r in docs.collect()]

    kept = corpus_pipeline.language_id(spark, docs, DATA).cache()
    assert kept.columns == docs.columns and {(r.score, r.lang_pred) for r in kept.collect()} == {(42.0, "mine")}
    letters = [(i, t) for i, t, _ in given if t and any(c.isalpha() for c in t)]
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(letters)
    assert all(r.lang for r in kept.collect())
    held = {(r.doc_id, r.text): r.lang for r in kept.collect()}
    assert all(held[i, t] == g for i, t, g in given if g and (i, t) in held)

    single = corpus_pipeline.near_duplicates(spark, kept, DATA).cache()
    stay = [(r.doc_id, r.text) for r in single.collect()]
    groups = one_of_each_group([(r.doc_id, r.text) for r in kept.collect()])
    assert single.columns == docs.columns and len(stay) == len(set(stay)) == len(groups)
    for group in groups:
        own = set(group) & set(stay)
        assert len(own) == 1
        ids = [i for i, _ in group if i is not None]
        assert next(iter(own))[0] == (min(ids) if ids else None)

    clean = corpus_pipeline.benchmark_free(spark, single, DATA).cache()
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    rest = {(r.doc_id, r.text) for r in clean.collect()}
    assert rest <= set(stay)
    said = [flat(t) for t in items if len(flat(t)) > 40]
    exact = {(i, t) for i, t in stay if any(s in flat(t) for s in said)}
    assert exact and not exact & rest and len(set(stay) - rest) < len(exact) + len(stay) / 10

    safe = corpus_pipeline.sanitised(spark, clean, DATA).cache()
    mails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert safe.count() == len(rest) and safe.columns == docs.columns
    assert any(mails.search(t) for _, t in rest) and not any(mails.search(r.text) for r in safe.collect())
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    tok = words.load(queries.tokenizer("byte_bpe_50k.json"))
    expected = collections.Counter()
    for r in safe.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        expected.update((r.doc_id, k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))
    final = corpus_pipeline.packed(spark, safe, DATA).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in final) == expected
    placed = collections.defaultdict(list)
    for r in final:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_pipeline_of_nothing_and_of_the_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert 100 < corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() < docs.count()


def test_rows_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    """With a hash of two values nearly all rows meet; they are drawn again until none do."""
    import corpus_pipeline

    real, drawn = F.xxhash64, []

    def poor(*columns):
        drawn.append(len(columns))
        return real(*columns) % (2 if len(drawn) <= 2 else 1 << 40)

    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", poor)
    docs = spark.createDataFrame([(k % 7, f"text {k % 50}") for k in range(100)] + [(None, None), (None, "")], "doc_id long, text string")
    key = corpus_pipeline.row_key(docs)
    monkeypatch.undo()
    rows = docs.select("doc_id", "text", key.alias("key")).distinct()
    assert len(drawn) > 2 and rows.count() == rows.select("key").distinct().count() == docs.distinct().count()

