"""Corpus operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, language, media, minhash, packing, pii, ppm, queries, repeats, shingles, token_counts, warc, words

DATA = "/root/testdata/sf0.001"
BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. "
ODD = [
    (9001, None), (9002, ""), (9003, " \n\t "), (9004, "a"), (9005, "12 34 !?"), (9006, "x" * 70000), (9007, BASE * 40), (9008, BASE * 40),
    (9008, BASE * 40), (9009, BASE * 39 + "one more word here"), (9010, "É été ÉTÉ 🎉 ́"), (9011, "word " * 30000), (None, "no id at all but some words in it"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Real and odd documents, with extra columns whose names clash with those of results."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    return real.unionByName(odd).withColumns({"key": F.lit("k"), "score": F.lit(1), "n_bytes": F.lit("x"), "piece": F.lit(None).cast("int"), "kind": F.lit(2)}).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]


def digest(rows):
    return collections.Counter(rows)


def test_packing(docs, rows):
    tok = words.load(queries.tokenizer("byte_bpe_50k.json"))
    found = packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), keep_ids=True).collect()
    expected = collections.Counter()
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    counts = collections.Counter(r.length for r in found)
    assert len(held) <= packing.lower_bound(counts, 1024) * 1.02 + 1


def test_token_counts(docs, rows):
    tok = words.load(queries.tokenizer("word_bpe_49k.json"))
    found = token_counts.count_tokens(docs, queries.tokenizer("word_bpe_49k.json"), chunk_chars=3000, overlap=200).collect()
    expected = [(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert digest(tuple(r) for r in found) == digest((*x, x[2] > 2048) for x in expected)


def test_media(docs, rows):
    found = media.digests(media.media(docs)).collect()
    assert digest((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in found) == digest(
        (i, len(b), hashlib.sha256(media.padded(b)).hexdigest(), zlib.crc32(media.padded(b)[-32:])) for i, b in ((i, (t or "").encode()) for i, t, _ in rows)
    )
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_language(docs, rows, spark):
    held = queries.id_crc() % 4 == 2
    profiles = language.learn(docs, ~held)
    found = language.identify(docs.withColumn("held_out", held), profiles).collect()
    assert len(found) == len(rows)
    tested = [r for r in found if r.held_out and r.lang]
    assert tested and sum(r.lang == r.lang_pred for r in tested) >= 0.95 * len(tested)
    for r in found:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in profiles and 0 <= r.score <= 1
    assert language.learn(docs, F.lit(False)) == {}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def thue_morse(n):
    """Two words of 2**n letters that polynomial hashes modulo a power of two confuse."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(2**n))
    return one, one.translate({97: "b", 98: "a"})


def test_near_duplicates_of_repeated_ids_and_confusable_words(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(200)) for w in ("lamp", "tree", "ship"))
    one, two = thue_morse(11)
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (11, one), (12, two), (13, f"{one} x y"), (14, f"{two} x y"), (20, c), (None, c + " end"), (None, ""), (21, ""), (22, "w " * 200_000), (23, "w w w w w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == {
        (5, 196, 5, True), (7, 197, 5, False), (9, 197, 5, False), (11, 1, 11, True), (12, 1, 12, True), (13, 1, 13, True), (14, 1, 14, True), (20, 196, 20, True), (None, 197, 20, False),
        (None, 0, None, True), (21, 0, 21, True), (22, 1, 22, True), (23, 1, 22, False),
    }


def test_near_duplicates(docs, rows, monkeypatch):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t, _ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    expected = digest((i, len(s), i if i is None else root(i), True if i is None else root(i) == i) for i, s in sets)
    for block in (512, 3):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert digest(tuple(r) for r in minhash.near_duplicates(docs).collect()) == expected


def test_circulant_signature_estimates_the_similarity():
    rand = np.random.default_rng(1)
    both, one, two = (np.unique(rand.integers(0, 2**64, n, dtype=np.uint64)) for n in (600, 100, 100))
    both, one, two = (np.array(list(zip(x, x, strict=True)), dtype=shingles.NAME) for x in (both, one, two))
    a, b = (minhash.signature(shingles.unique(np.concatenate((both, x))), 1024) for x in (one, two))
    assert abs((a == b).mean() - 600 / 800) < 0.06


def test_repeats(docs, rows, spark):
    rand = random.Random(4)
    base = "".join(rand.choice("abcdefgh ") for _ in range(3000))
    line = "The same line stands in every one of them, of sixty bytes."
    extra = [(8000, base), (8001, base[:1000] + "x" + base[1000:]), (8002, base[500:700] * 3), (8003, "a" * 700), (8004, "ab" * 300), (8005, "b" * 99), (8006, "c" * 100), (8007, "é" * 200)]
    extra += [(8100 + k, "".join(rand.choice("abcdefgh ") for _ in range(300)) + line + "".join(rand.choice("abcdefgh ") for _ in range(rand.randint(0, 300)))) for k in range(40)]
    extra += [(8200 + k, base[: rand.randint(0, 50)] + base[1000 : 1000 + rand.randint(90, 300)]) for k in range(40)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(i, (t or "").encode()) for i, t in [(i, t) for i, t, _ in rows] + extra]
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    first = {}
    for i, b in order:
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (i, p))
    expected = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (i, p):
                gone[p : p + 100] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    for settings in ({}, {"hot": 3, "shard": 20000}):
        found = repeats.remove_repeats(every, **settings).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_segments_of_parts_hold_every_window_once(monkeypatch):
    raw = bytes(random.Random(1).choice(b"ab cd") for _ in range(5000))
    monkeypatch.setattr(repeats, "PART", 700)
    held = sorted(p for s in repeats.cut(raw, 1) for a, n in zip(s["pos"], s["n"], strict=True) for p in range(a, a + n))
    assert held == list(range(len(raw) - 99))


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def luhn(d):
        return sum((int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_patterns(docs, rows, spark):
    rand = random.Random(2)
    bits = ["1", "2", "4", "0", "55", "192", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "🎉", "%", "x@y.z", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1", "000255"]
    more = [(7000 + k, "".join(rand.choice(bits) for _ in range(rand.randint(0, 60)))) for k in range(600)]
    more += [(7900, "1" * 30000), (7901, "a" * 30000 + "@"), (7902, "10.1.1.1 " * 500), (7903, "1 " * 20000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = pii.report(pii.detect(every)).collect()
    expected = collections.Counter()
    for i, t in [(i, t) for i, t, _ in rows] + more:
        spans = base_spans(t or "")
        n = collections.Counter(k for k, _, _ in spans)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:6] for r in found) == expected


def test_terms_that_disclose_an_entity_go(spark):
    filler = ["the river runs through green valleys and over stones", "people walk along their streets every morning before work", "some birds sing while other animals sleep under trees"]
    data = [(k, f"{filler[k % 3]} note{k} Zanzibar wrote from zed@host.org about item{k}, {filler[(k + 1) % 3]}") for k in range(6)]
    data += [(100 + k, f"{filler[k % 3]} and {filler[(k + 1) % 3]} about nothing wrote from here") for k in range(60)]
    docs = spark.createDataFrame([(i, t, "e", t, 5) for i, t in data], "doc_id long, text string, _email string, _text string, rows int")
    assert {(r._email, r._text == dict(data)[r.doc_id], r.rows) for r in pii.sanitise(docs.withColumn("_hash", F.lit(1)).withColumn("row", F.lit(2))).collect()} == {("e", True, 5)}
    found = {r.doc_id: r for r in pii.report(pii.detect(docs)).collect()}
    for i, t in data:
        at = t.find("Zanzibar")
        if i < 100:
            assert f"term:{at}:{at + 8}" in found[i].spans and found[i].n_email == 1
            assert "wrote" not in [t[int(a) : int(b)] for _, a, b in (s.split(":") for s in found[i].spans.split(","))]
        else:
            assert found[i].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("Zanzibar" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6)) and clean[100] == dict(data)[100]


def disclosed(texts):
    """Brute force: {term: replacement} of the terms that disclose an entity."""
    texts = sorted(set(texts))
    n = len(texts)
    plain, contexts = {}, {}
    for t in texts:
        p = list(t)
        for _, a, b in base_spans(t):
            p[a:b] = " " * (b - a)
        plain[t] = "".join(p)
    words = {t: {m.lower() for m in re.findall(r"[^\W\d_]{4,}", plain[t])} for t in texts}
    df = collections.Counter(w for t in texts for w in words[t])
    where, co, seen = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for t in texts:
        for kind, a, b in base_spans(t):
            e = (kind, t[a:b].lower())
            low = max(0, a - pii.WINDOW)
            near = {m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", plain[t]) if low <= m.start() and m.end() <= a or b <= m.start() and m.end() <= b + pii.WINDOW}
            # a word that reaches the edge of the window is whole only where the text ends
            near -= {m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", plain[t][low:a]) if m.start() == 0 and low > 0}
            near -= {m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", plain[t][b : b + pii.WINDOW]) if m.end() == pii.WINDOW and b + pii.WINDOW < len(t)}
            where[e].add(t)
            context = (t[low:a], t[b : b + pii.WINDOW])
            contexts[context] = near
            for w in near:
                co[e, w].add(t)
                seen[e, w].add(context)
    worst = {}
    for (e, w), held in co.items():
        ic = math.log(n / len(where[e]))
        score = round(math.log(len(held) * n / (len(where[e]) * df[w])) / ic, 6) if ic > 0 else 0.0
        rare = len(held) * math.log(len(where[e]) * df[w] / n) <= math.log(pii.CHANCE) + 1e-9
        if (len(seen[e, w]) >= pii.SUPPORT or rare) and score >= pii.THRESHOLD:
            worst[w] = max(score, worst.get(w, 0))
    out = {}
    for w, score in worst.items():
        own = [near for near in contexts.values() if w in near]
        wider = [(df[g], g) for g in set().union(*own) if df[g] > df[w] and g not in worst and sum(g in near for near in own) >= pii.SUBSUMES * len(own)]
        out[w] = "" if score >= pii.REMOVE else min(wider)[1] if wider else "[TERM]"
    return out


def test_terms_are_those_of_brute_force_with_and_without_copies(spark):
    rand = random.Random(11)
    common = ["river", "green", "valley", "people", "street", "morning", "animal", "sleep", "stone", "winter"]
    people = [("zanzibar", "zed@host.org"), ("quixote", "10.1.2.3"), ("ulysses", "+1 (555) 123-4567"), ("hamlet", "4111 1111 1111 1111")]
    data = []
    for k in range(400):
        text = " ".join(rand.choices(common, k=12))
        if k < 40:
            name, value = people[k % 4]
            text = f"{text} {name if rand.random() < 0.9 else 'someone'} captain {value} {' '.join(rand.choices(common, k=rand.randint(1, 14)))}"
        elif k < 44:
            text += f" {people[k % 4][0]} alone {k}"
        data.append((k, text))
    known = disclosed([t for _, t in data])
    assert {"zanzibar", "quixote", "ulysses", "hamlet"} <= set(known) and set(known.values()) - {"", "[TERM]"}
    copies = data + data[:9] * 5 + data[60:70] * 3 + [(None, None), (900, "")]
    for rows in (data, copies):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for r in pii.detect(docs).collect():
            found = [((r.row.text or "")[s.start : s.end].lower(), s.value) for s in r.term]
            plain = r.row.text or ""
            for _, a, b in base_spans(plain):
                plain = plain[:a] + " " * (b - a) + plain[b:]
            assert found == [(w, known[w]) for w in re.findall(r"[^\W\d_]{4,}", plain.lower()) if w in known]
        for r in pii.sanitise(docs).collect():
            assert not {w for w in re.findall(r"[^\W\d_]{4,}", (r.text or "").lower())} & set(known)


def test_copies_do_not_change_terms(spark):
    filler = ["the river runs through green valleys", "people walk along their streets", "some birds sing under trees"]
    data = [(k, f"{filler[k]} and Zanzibar wrote from zed@host.org about {filler[k - 1]}") for k in range(3)]
    data += [(100 + k, f"{filler[k % 3]} number {k} wrote about nothing from here") for k in range(60)]
    once = {(r.doc_id, r.spans) for r in pii.report(pii.detect(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    copied = data + data[:3] * 30 + data[5:9] * 7
    again = pii.report(pii.detect(spark.createDataFrame(copied, "doc_id long, text string"))).collect()
    assert {(r.doc_id, r.spans) for r in again} == once and len(again) == len(copied)
    assert all("term:" in s for i, s in once if i < 100)


def test_terms_of_rarely_named_entities_go_everywhere(spark):
    filler = ["the river runs through green valleys", "people walk along their streets", "some birds sing under trees"]
    far = " ".join(filler * 3)
    data = [(k, f"{filler[k % 3]} and nothing else {k}") for k in range(3000)]
    data += [(5000, f"{filler[0]} Zanzibar owns +1 (555) 123-4567 and walks. {far}. ZANZIBAR again"), (5001, f"{far} zanzibar without a number"), (5002, "people at 10.0.0.1 walk")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(pii.detect(docs)).collect()}
    for i, t in data:
        terms = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].spans.split(",") if s) if k == "term"]
        assert [w for w in terms if w.lower() == "zanzibar"] == re.findall("zanzibar", t, re.I), i
        assert i >= 5000 or not terms
    assert found[5000].n_term == 4 and found[5001].n_term == 1 and found[5002].n_term == 0  # owns and walks stand nowhere else


def test_overlapping_spans_go_whole(spark):
    cases = {
        "+491234567@host.com now": "[EMAIL] now", "a 4111-1111-1111-1111@x.com": "a [EMAIL]", "10.0.0.1joe@x.com": "[EMAIL]", "+1 555 123 4567-joe@x.com b": "[PHONE] b",
        "x@y.com 10.0.0.1": "[EMAIL] [IP]",
    }
    filler = ["the river runs through green valleys", "people walk along their streets", "some birds sing under trees"]
    data = [*enumerate(cases), *((10 + k, f"{filler[k]} Footer, alice@x.com or +1 (555) 123-4567 {filler[k - 1]}") for k in range(3))]
    data += [(100 + k, f"{filler[k % 3]} number {k} about nothing") for k in range(60)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [clean[k] for k in range(len(cases))] == list(cases.values())
    for k in range(3):
        assert "[EMAIL] or [PHONE]" in clean[10 + k] and "x.com" not in clean[10 + k] and "Footer" not in clean[10 + k]


def test_ppm(docs, rows, spark):
    one, two = thue_morse(10)
    odd = spark.createDataFrame([(9101, one + "\0"), (9102, "\0" + two), (9103, two), (9104, one), (9105, "\0\0")], "doc_id long, text string")
    small = docs.where("length(text) < 2500 or text is null or doc_id > 9000 and length(text) < 6000").select("doc_id", "text").unionByName(odd)
    data = [(r.doc_id, r.text) for r in small.collect()]
    name = {i: str(i) if i is not None else "" for i, _ in data}
    learnt = [(t or "").encode() for i, t in data if zlib.crc32(name[i].encode()) % 5 != 1]
    trie = [collections.defaultdict(collections.Counter) for _ in range(4)]
    words = collections.Counter()

    def tokens(b):
        return [*re.findall(rb"[^\x20\x09-\x0d]+", b.lower()), "end"]

    for b in learnt:
        p = b"\xff\xff\xff" + b + b"\xff"
        for k in range(3, len(p)):
            for o in range(4):
                trie[o][p[k - o : k]][p[k]] += 1
        words.update(tokens(b))
    n, v = sum(words.values()), len(words)
    expected = {}
    for i, t in data:
        b = (t or "").encode()
        p = b"\xff\xff\xff" + b + b"\xff"
        total = 0.0
        for k in range(3, len(p)):
            out, q = set(), 1.0
            for o in (3, 2, 1, 0):
                left = {s: c for s, c in trie[o].get(p[k - o : k], {}).items() if s not in out}
                if not left:
                    continue
                size = sum(left.values()) + len(left)
                if p[k] in left:
                    q *= left[p[k]] / size
                    break
                q *= len(left) / size
                out |= set(left)
            else:
                q /= 256 - len(out)
            total += math.log10(q)
        own = tokens(b)
        expected[i, b] = (zlib.crc32(name[i].encode()) % 5 == 1, len(own), sum(words[w] > 0 for w in own), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), total)
    for size, fan in ((1 << 22, None), (20000, None), (20000, 3)):
        found = ppm.score(small, queries.id_crc() % 5 == 1, chunk_bytes=size, fan=fan).join(small.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).collect()
        assert len(found) >= len(data)
        for r in found:
            e = expected[r.doc_id, (r.text or "").encode()]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
            assert r.base_score == pytest.approx(e[4], rel=1e-10) and r.score == pytest.approx(e[5], rel=1e-10)


def test_decontamination(docs, rows, spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "short"), (903, BASE * 2)], "item_id long, text string"))
    found = decontaminate.matches(docs, items).collect()
    normal = {(i, t): decontaminate.normal(t or "") for i, t, _ in rows}
    exact = {(i, r.item_id) for i, t, _ in rows for r in items.collect() if decontaminate.normal(r.text or "") and f" {decontaminate.normal(r.text)} " in f" {normal[i, t]} "}
    assert exact <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.distance <= decontaminate.budget(r.item_chars, decontaminate.RATE) for r in found)
    small = decontaminate.matches(docs, items, block_chars=500).collect()  # several passes
    assert digest(tuple(r) for r in small) == digest(tuple(r) for r in found)
    bad = {r.doc_id for r in found}
    kept = decontaminate.clean(docs, items, block_chars=2000)
    assert kept.columns == docs.columns
    assert digest(r.doc_id for r in kept.collect()) == digest(i for i, _, _ in rows if i not in bad)
    assert decontaminate.matches(docs, items.where("false")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x", 5), (2, None, None, 5), (2, None, None, 5)], "page_id long, url string, html string, block int")
    found = warc.derivatives(pages).collect()
    assert digest((r.page_id, r.warc_type) for r in found) == {(1, "metadata"): 1, (1, "conversion"): 1, (2, "metadata"): 2, (2, "conversion"): 2}
    assert len({r.record_id for r in found}) == 4
    assert warc.derivatives(pages.where("false")).count() == 0


def test_warc_files_as_a_source(spark, tmp_path):
    import gzip

    message = b"HTTP/1.1 200 OK\r\nX-A: 1\r\nX-A: 2\r\n\r\n<title>T</title>x"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(message) + message + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record.replace(b"response", b"request", 1) + record)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    found = warc.derived(warc.read(spark, str(tmp_path))).collect()
    assert len(found) == 6 and {(r.refers_to, r.warc_date, r.target_uri) for r in found} == {("<urn:uuid:1>", "2020-01-01T00:00:00Z", "http://a/")}
    assert all(b"source-header: X-A: 1\r\nsource-header: X-A: 2\r\ntitle: T" in r.block for r in found if r.warc_type == "metadata")


def test_empty_tables(docs, spark):
    none = docs.where("false")
    ranks, words = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
    for df in (
        packing.pack(none, ranks), token_counts.count_tokens(none, words), media.digests(media.media(none)), language.identify(none, language.learn(none, F.lit(True))),
        minhash.near_duplicates(none), repeats.remove_repeats(none), pii.report(pii.detect(none)), pii.sanitise(none), ppm.score(none, F.lit(True)),
        decontaminate.matches(none, spark.read.parquet(f"{DATA}/benchmark.parquet")),
    ):
        assert df.count() == 0


def test_rows_without_an_id_of_their_own_go_only_as_copies(spark):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{w}{k}" for k in range(60)) for w in ("lamp", "tree", "ship", "bird"))
    data = [(5, one), (None, one), (None, two), (None, three), (None, three + " end"), (7, four), (7, one + " end"), (7, four), (3, one)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(kept, key=str)[:2] == [(3, one), (7, four)] and (None, two) in kept
    assert len(kept) == 4 and len({(None, three), (None, three + " end")} & set(kept)) == 1


def test_pipeline_stages_keep_columns_and_rows(docs, spark, rows):
    import corpus_pipeline

    raw = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.columns
        kept = stage(spark, kept, DATA).cache()
        assert kept.columns == before, name
    assert 0 < kept.count() < len(rows)
    final = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_near_duplicates_equal_their_sql(spark):
    import duckdb

    words = [f"w{i}" for i in range(40)]
    near = [*words[:39], "other"]
    data = [(5, " ".join(words)), (3, " ".join(near)), (9, "  ".join(words).upper()), (7, None), (8, ""), (2, "one two"), (1, "ONE\ttwo"), (4, "one two three"), (6, " \x0b\r\n"), (10, " ".join(words[:20] + near[20:30])), (11, "Ä b c d e f"), (12, "ä b c d e f")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = minhash.near_duplicates(docs)
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", data)
    assert rows == set(base.execute(queries.oracle_sql()["op6_near_duplicates"]).fetchall())
    assert {r[2] for r in rows if r[0] in (3, 5, 9)} == {3}
