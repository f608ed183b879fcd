"""Parts of the corpus operators that need no session."""

import collections
import html.parser
import random
import struct
import time
import unicodedata

import numpy as np
import pytest

from sparkloom.llm import decontaminate, language, media, packing, suffix, token_counts, warc, words
from sparkloom.llm.queries import tokenizer


def test_suffix_array_and_common_prefixes(monkeypatch):
    rand = random.Random(1)
    for large in (2048, 3):
        monkeypatch.setattr(suffix, "LARGE", large)
        for _ in range(400):
            t = bytes(rand.choice(b"abcd"[: rand.randint(1, 4)]) for _ in range(rand.randint(1, 60))) * rand.randint(1, 3)
            a = np.frombuffer(t, np.uint8)
            sa = suffix.suffix_array(a)
            expected = sorted(range(len(t)), key=lambda i: t[i:])
            assert sa.tolist() == expected
            lcp = suffix.permuted_lcp(a, sa)
            for k in range(1, len(t)):
                x, y = t[expected[k] :], t[expected[k - 1] :]
                same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert lcp[expected[k]] == same
    assert len(suffix.suffix_array(np.zeros(0, np.uint8))) == 0


def test_myers_is_the_edit_distance_to_the_best_substring():
    rand = random.Random(5)
    for _ in range(800):
        p = "".join(rand.choice("abc") for _ in range(rand.randint(1, 12)))
        t = "".join(rand.choice("abcd") for _ in range(rand.randint(0, 20)))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.myers(decontaminate.masks(p), len(p), t) == (min(row), row.index(min(row)))


def test_pigeonhole_finds_every_match_within_the_budget():
    rand = random.Random(9)
    item = " ".join("".join(rand.choice("abcdefghij") for _ in range(rand.randint(3, 8))) for _ in range(30))
    block = decontaminate.Block([(7, item)], 0.08)
    k = decontaminate.budget(len(item), 0.08)
    for edits in range(k + 1):
        x = list(item)
        for _ in range(edits):
            at = rand.randrange(len(x))
            kind = rand.randrange(3)
            if kind == 0:
                x[at] = "z"
            elif kind == 1:
                del x[at]
            else:
                x.insert(at, "z")
        found = block.find("before it " + "".join(x) + " after it")
        assert [f[0] for f in found] == [7] and found[0][1] <= edits
    assert block.find("nothing of the kind " * 30) == []
    other = item[:40] + "z" + item[41:]
    assert [f[1] for f in block.find(f"{item} x {other} {item}{item}")] == [0, 1, 0, 0]  # every passage
    short = decontaminate.Block([(1, "who wrote it"), (2, "a")], 0.08)
    assert short.find("who wrote it then who wrote it") == [(1, 0, 12, 0, 12), (1, 0, 12, 18, 30)]
    assert short.find("who wrote items") == [] and short.find("who rote it") == [] and [f[0] for f in short.find("b a")] == [2]


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 40000])
def test_media_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    padded = media.padded(data)
    assert len(padded) % media.FRAME == 0 and padded and padded.startswith(data)
    (track,) = media.tracks(media.write(padded))
    assert media.payload(media.write(padded), track) == padded
    assert track.codec == "raw " and track.duration == len(track.samples) == len(track.keys)


def test_media_key_frames_and_broken_files():
    data = media.write(bytes(576 * 40), keys=[1, 33])
    (track,) = media.tracks(data)
    assert track.keys == [1, 33]
    assert media.key_frames(bytes(576 * 3) + b"z" * 576 + bytes(576 * 30)) == [1, 4, 5, 29]
    for bad in (media.write(bytes(576), keys=[2]), media.write(bytes(576), keys=[0]), data.replace(struct.pack(">IIII", 0, 0, media.SCALE, 40), bytes(16)), b"".join(struct.pack(">I4s", 8 * (2000 - k), b"moov") for k in range(2000))):
        with pytest.raises(ValueError):
            media.tracks(bad)
    rand = random.Random(4)
    for _ in range(3000):  # any damage gives tracks or ValueError
        hurt = bytearray(data[:700])
        for _ in range(rand.randint(1, 4)):
            hurt[rand.randrange(len(hurt))] = rand.randrange(256)
        try:
            media.tracks(bytes(hurt) + data[700:])
        except ValueError:
            pass


def test_media_fragments():
    whole = media.write(bytes(576))
    (first,) = media.tracks(whole)
    run = media.full(b"trun", struct.pack(">Ii", 3, 0), struct.pack(">IIIIII", 10, 0, 20, 0x10000, 30, 0), flags=0x601)
    size = len(media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">II", 1, 7), flags=8), run)))
    run = run.replace(struct.pack(">Ii", 3, 0), struct.pack(">Ii", 3, size + 8))
    data = whole + media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">II", 1, 7), flags=8), run)) + media.box(b"mdat", bytes(60))
    (track,) = media.tracks(data)
    at = len(whole) + size + 8
    assert track.samples == [*first.samples, (at, 10), (at + 10, 20), (at + 30, 30)] and track.keys == [1, 2, 4]
    assert track.duration == first.duration + 21


def test_media_tables_by_an_independent_reader():
    """Places of the tables by their names, and their numbers one after another."""
    payload = media.padded(bytes(random.Random(7).randrange(64, 128) for _ in range(30000)) + b"\0" * 9000)
    data = media.write(payload, keys=media.key_frames(payload))

    def numbers(name, skip, form):
        at = data.index(name) + 4 + skip
        (count,) = struct.unpack_from(">I", data, at)
        return [struct.unpack_from(">" + form, data, at + 4 + k * struct.calcsize(">" + form)) for k in range(count)]

    chunks = [x for (x,) in numbers(b"stco", 4, "I")]
    n = len(payload) // 576
    samples = [(chunks[k // 32] + k % 32 * 576, 576) for k in range(n)]
    (track,) = media.tracks(data)
    assert track.samples == samples and track.keys == [x for (x,) in numbers(b"stss", 4, "I")] and 1 < len(track.keys) < n
    assert b"".join(data[a : a + 576] for a, _ in samples) == payload


def test_plan_holds_every_piece_and_meets_the_bound():
    rand = random.Random(3)
    for n in (0, 1, 40, 3000):
        counts: dict[int, int] = {}
        for _ in range(n):
            x = rand.randint(1, 1024)
            counts[x] = counts.get(x, 0) + 1
        plan = packing.plan(counts, 1024)
        got: dict[int, int] = {}
        for lengths, times in plan:
            assert sum(lengths) <= 1024
            for x in lengths:
                got[x] = got.get(x, 0) + times
        assert got == counts
        assert sum(t for _, t in plan) <= packing.lower_bound(counts, 1024) * 1.02 + 1
    assert packing.plan({6: 2, 4: 2, 5: 2}, 10) and sum(t for _, t in packing.plan({6: 2, 4: 2, 5: 2}, 10)) == 3
    assert packing.dominates((5, 3), (4, 1, 3)) and not packing.dominates((4, 4), (5, 3))


def test_pieces_are_full_but_the_first():
    assert packing.cut(1, 1024) == [(0, 1)]
    assert packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_by_word_are_those_of_whole_texts(name, monkeypatch):
    tok, own = words.load(tokenizer(name)), words.Words(tokenizer(name))
    rand = random.Random(2)
    bits = [*" \t\n\r\x0b\x85\xa0　ab'sStdveé1２٣!?-🎉́\x00\x1c|", "don't", "It's", "ÉTÉ", "ß", "ÿ", "Ÿ", "º", "²", "×", "12", "x1y,z", "<|endoftext|>", "<|startoftext|>", "...", "İ", "end.\nNext"]

    def ids(texts):
        return [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]

    for k in range(60):
        if k == 40:
            monkeypatch.setattr(words, "KNOWN", 50)  # the table overflows
        texts = ["".join(rand.choice(bits) + rand.choice(["", "", " "]) for _ in range(rand.randint(0, 25))) for _ in range(30)]
        assert ids(texts) == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for text in (" " * 1_000_000, "x" * 1_000_000, "a b " * 100_000, "\n" * 300_000):
        assert ids([text]) == [tok.encode(text, add_special_tokens=False).ids]


def test_an_exhaustive_search_finds_the_fewest_bins():
    rand = random.Random(8)
    for _ in range(25):
        sizes = [rand.randint(1, 12) for _ in range(rand.randint(1, 9))]
        best = len(sizes)

        def fill(at, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if at == len(sizes):
                best = len(bins)
                return
            for k in {r: k for k, r in enumerate(bins) if r >= sizes[at]}.values():
                fill(at + 1, [*bins[:k], bins[k] - sizes[at], *bins[k + 1 :]])
            fill(at + 1, [*bins, 12 - sizes[at]])

        fill(0, [])
        counts = {x: sizes.count(x) for x in sizes}
        assert sum(t for _, t in packing.plan(counts, 12, None, None, None)) == best


def test_spliced_counts_equal_whole_counts():
    tok = words.load(tokenizer("word_bpe_49k.json"))
    rand = random.Random(2)
    letters = "    \t\nab'sStdveé1٣!?-🎉́abcdefgh"
    for _ in range(150):
        text = "".join(rand.choice(letters) for _ in range(rand.randint(0, 600)))
        for chunk, overlap in ((20, 5), (50, 20)):
            assert token_counts.count_long(tok, text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_long(tok, "x" * 5000, 100, 10) == len(tok.encode("x" * 5000, add_special_tokens=False).ids)


def test_rank_order_profiles():
    assert language.classify(None, {}) == ("und", 0.0)
    assert len(language.grams("12 34 !")) == 0
    profile = language.ranked(language.grams("the cat and the dog and the bird"), 400)
    order = np.argsort(profile)
    profiles = {"en": (profile[order], order), "xx": (np.array([1, 2]), np.array([0, 1]))}
    assert language.classify("the dog", profiles)[0] == "en"
    assert language.classify("12", profiles) == ("und", 0.0)


def test_profiles_and_distances_by_brute_force():
    rand = random.Random(3)
    letters = "aábcdeéfghiß '-.1\n"

    def ranked(text):
        words = ["_" + w + "_" for w in "".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFC", text).lower()).split()]
        n = collections.Counter(w[i : i + k].replace("_", " ") for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1) if w[i : i + k] != "_")
        # blanks between two words are one character
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))][:400]

    training = {name: "".join(rand.choice(letters[k : k + 9] + " ") for _ in range(600)) for k, name in ((0, "aa"), (4, "bb"), (7, "cc"))}
    profiles = {}
    for name, text in training.items():
        own = language.ranked(language.grams(text), 400)
        order = np.argsort(own)
        profiles[name] = own[order], order
    for _ in range(200):
        text = "".join(rand.choice(letters) for _ in range(rand.randint(0, 80)))
        own = ranked(text)
        far = {n: sum(abs(p.index(g) - k) if g in p else 400 for k, g in enumerate(own)) for n, p in ((n, ranked(t)) for n, t in training.items())}
        best = min(far, key=lambda n: (far[n], n))
        assert language.classify(text, profiles) == ((best, 1 - far[best] / (400 * len(own))) if own else ("und", 0.0))


def test_warc_records_are_linked_and_read_back():
    markup = "<html lang='fr'><title>A &amp; B</title><script>no<a href='x'></script><p>One<p>two <b>three</b><a href=\"/u?a=1&amp;b=2\">l</a><!-- c"
    block = warc.response("http://h/", markup)
    source = warc.record_id("http://h/", "d", warc.digest(block))
    meta, text = warc.derive(source, "http://h/", "d", block)
    for r in (meta, text):
        ((head, body),) = warc.parse(warc.serialise(r[9], r[10]))
        assert head["WARC-Refers-To"] == source and body == r[10] and head["WARC-Block-Digest"] == warc.digest(body)
        assert head["WARC-Source-Payload-Digest"] == warc.digest(markup.encode())
    assert b"outlink: /u?a=1&b=2" in meta[10] and b"title: A & B" in meta[10] and b"html-lang: fr" in meta[10] and b"outlink: x" not in meta[10]
    assert text[10].decode() == "A & B\nOne\ntwo threel"
    status, fields, body = warc.split_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n3\r\nabc\r\n2;e\r\nde\r\n0\r\n\r\n")
    assert body == b"abcde" and fields == [("Transfer-Encoding", "chunked"), ("X", "a b")]


def test_warc_of_hostile_sources():
    for head, body, text in (
        ("Content-Type: text/html; charset=undefined", b"<p>caf\xc3\xa9", "café"), ("Content-Type: text/html; charset=idna", b"a..b", "a..b"), ("Content-Type: text/html; charset=latin-1", b"\xe9", "é"),
        ("Transfer-Encoding: chunked", b"3\r\nabc\r\nzz\r\nrest", "abczz\nrest"), ("Transfer-Encoding: chunked", b"-1\r\nab", "-1\nab"),
    ):
        meta, found = warc.derive("<urn:x>", "u", "d", f"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\n{head}\r\nSet-Cookie: b\r\n\r\n".encode() + body)
        assert found[10].decode() == text
        assert [x for x in meta[10].decode().splitlines() if x.startswith("source-header")] == [f"source-header: {x}" for x in ("Set-Cookie: a", head, "Set-Cookie: b")]
    for part in ("<a ", "<title>", "<title ", "<html ", "<p ", "<script ", "<script>", "<!--", "<a href=\"", "</", "href =", "<"):
        start = time.process_time()
        warc.derive("<urn:x>", "u", "d", warc.response("u", part * 200_000))
        assert time.process_time() - start < 5, part
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab")


class _Reader(html.parser.HTMLParser):
    """Title, links, language and visible words by the standard library's parser."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.links, self.lang, self.title, self.words, self.inside = [], "", None, [], []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and "href" in values:
            self.links.append((values["href"] or "").strip())
        if tag == "html" and not self.lang:
            self.lang = (values.get("lang") or "").lower()
        if tag in ("script", "style", "noscript", "template", "title"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "title" in self.inside and self.title is None:
            self.title = " ".join(data.split())
        if not set(self.inside) - {"title"}:
            self.words += data.split()


def test_warc_by_an_independent_reader():
    import pyarrow.parquet as pq

    for url, markup in zip(*(pq.read_table("/root/testdata/sf0.001/pages.parquet").column(c).to_pylist() for c in ("url", "html")), strict=True):
        meta, text = warc.derive("<urn:x>", url, "d", warc.response(url, markup))
        lines = meta[10].decode().splitlines()
        own = _Reader(markup)
        assert [x[9:] for x in lines if x.startswith("outlink: ")] == [" ".join(x.split()) for x in own.links if x]
        assert [x[7:] for x in lines if x.startswith("title: ")] == [own.title] * bool(own.title)
        assert "".join(text[10].decode().split()) == "".join(own.words)
