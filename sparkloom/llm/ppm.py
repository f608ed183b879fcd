"""Language-model scores by prediction by partial matching.

The model is a byte-context trie of order three over the training texts, each
with three bytes 255 before it and one, the end, after it (no UTF-8 text holds
that byte, so the end is a symbol of its own).  A byte's probability
is that of PPM, method C: at the longest known context it is n / (T + D), with T
occurrences and D distinct bytes there; a byte not seen there escapes with
D / (T + D) to the next shorter context, in which the bytes of the longer one are
excluded; bytes seen nowhere share what is left.  A score depends on 4-grams
only, so it is computed once for each distinct one.

The trie and the word counts are never in one place.  Documents are dealt into
chunks; a chunk asks for the distinct words and 4-grams it holds.  Requests meet
by bucket (words by hash, 4-grams by their two middle bytes, so a bucket holds
all contexts of order two and three it needs), with the training counts of all
chunks; the answers go back to the chunks.  With more than ``fan`` chunks the
counts of a bucket are first merged, ``fan`` requests at a time, until one table
is left, and the chunks' requests meet copies of it, ``fan`` a copy; so no task
grows with the number of chunks.  Orders one and zero are a table of at most
65,536 counts, which is broadcast.  Words are told apart by 128-bit hashes.

Defined results: a null or empty text is its end alone; texts may be of any
length; equal texts have equal scores; with nothing to learn from every byte has
probability 1/256; a row with a null doc_id counts as the empty id; an empty table
gives an empty table; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .groups import Group, map_groups
from .shingles import NAME, mix, unique, word_names

CHUNK_BYTES = 4 << 20
BUCKETS = 4096
WORDS, GRAMS = 1, 2
REQUESTS = "kind int, bucket int, chunk long, keys binary, counts binary"
ANSWERS = "chunk long, kind int, bucket int, data binary, distinct long, tokens long"
TABLES = "kind int, bucket int, keys binary, data binary, distinct long, tokens long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def grams(raw: bytes) -> np.ndarray:
    """The 4-grams of a text in order, as big-endian numbers."""
    a = np.frombuffer(b"\xff\xff\xff" + raw + b"\xff", dtype=np.uint8).astype(np.uint32)
    return a[:-3] << np.uint32(24) | a[1:-2] << np.uint32(16) | a[2:-1] << np.uint32(8) | a[3:]


_TYPE = {WORDS: NAME, GRAMS: np.dtype("<u4")}
_VALUE = {WORDS: np.dtype("<i8"), GRAMS: np.dtype("<f8")}


def _different(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and how often each occurs."""
    return unique(keys, counts=True) if kind == WORDS else np.unique(keys, return_counts=True)


def _order(kind: int, keys: np.ndarray) -> np.ndarray:
    return np.lexsort((keys["b"], keys["a"])) if kind == WORDS else np.argsort(keys, kind="stable")


def _lookup(kind: int, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` in a sorted ``table`` that holds all of them."""
    if kind == GRAMS:
        return np.searchsorted(table, keys)
    at = np.searchsorted(table["a"], keys["a"])
    while (wrong := np.flatnonzero(table["b"][at] != keys["b"])).size:  # another word with the same first half
        at[wrong] += 1
    return at


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    keys = mix((keys.astype(np.uint64) >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == GRAMS else keys["a"]
    return (mix(keys) % np.uint64(buckets)).astype(np.int32)


def _counted(kind: int, learnt: list[np.ndarray], other: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys, sorted, and how often each is in ``learnt``."""
    none = np.zeros(0, _TYPE[kind])
    keys, n = _different(kind, np.concatenate([none, *learnt]))
    more, _ = _different(kind, np.concatenate([none, *other]))
    return _merged(kind, [keys, more], [n, np.zeros(len(more), np.int64)])


def _merged(kind: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of counts as one."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = _order(kind, every)
    every, n = every[order], n[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    return every[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def _wanted(raws: list[bytes], train: list[bool]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, the keys of a chunk and their training counts."""
    out = {}
    for kind, fn in ((WORDS, word_names), (GRAMS, grams)):
        found = [fn(x) for x in raws]
        out[kind] = _counted(kind, [x for x, t in zip(found, train, strict=True) if t], [x for x, t in zip(found, train, strict=True) if not t])
    return out


def _by_bucket(kind: int, keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys), in the order in which answers come."""
    at = _bucket(kind, keys, buckets)
    order = np.argsort(at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(found) else []


def log_probabilities(codes: np.ndarray, n: np.ndarray, order1: np.ndarray) -> np.ndarray:
    """log10 P of the last byte of each distinct 4-gram, given the counts of all 4-grams with the same middle bytes."""
    symbol = (codes & 0xFF).astype(np.int64)
    c3 = ((codes >> np.uint32(8)) & 0xFF).astype(np.int64)
    known1 = order1 > 0
    order0 = order1.sum(axis=0)
    known0 = order0 > 0

    def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(keys, return_inverse=True)

    def total(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at, values, size)

    ctx3, in3 = place(codes >> np.uint32(8))
    pair, at_pair = place(codes & np.uint32(0xFFFFFF))  # contexts of order two with their bytes
    n2 = total(at_pair, n, len(pair))
    ctx2, in2 = place(pair >> np.uint32(8))
    pair_c3, pair_symbol = (ctx2[in2] & 0xFF).astype(np.int64), (pair & 0xFF).astype(np.int64)
    seen, seen2 = n > 0, n2 > 0
    t3, d3 = total(in3, n, len(ctx3)), total(in3, seen, len(ctx3))
    out3 = total(in3, np.where(seen, n2[at_pair], 0), len(ctx3))  # what order three excludes from order two
    t2, d2 = total(in2, n2, len(ctx2)), total(in2, seen2, len(ctx2))
    out2 = total(in2, np.where(seen2, order1[pair_c3, pair_symbol], 0), len(ctx2))
    t1, d1 = order1.sum(axis=1), known1.sum(axis=1)
    out1 = (known1 * order0[None, :]).sum(axis=1)
    t0, d0 = order0.sum(), known0.sum()

    p = np.ones(len(codes))
    done = np.zeros(len(codes), dtype=bool)
    of2 = in2[at_pair]
    for count, t, d in (
        (n, t3[in3], d3[in3]),
        (n2[at_pair], (t2[of2] - out3[in3]), (d2[of2] - d3[in3])),
        (order1[c3, symbol], (t1[c3] - out2[of2]), (d1[c3] - d2[of2])),
        (order0[symbol], (t0 - out1[c3]), (d0 - d1[c3])),
    ):
        alive = ~done & (t + d > 0)
        hit = alive & (count > 0)
        p[hit] *= count[hit] / (t + d)[hit]
        done |= hit
        escape = alive & ~hit
        p[escape] *= d[escape] / (t + d)[escape]
    p[~done] /= max(1, 256 - d0)
    return np.log10(p)


def _combine(group: Group) -> Iterator[pa.RecordBatch]:
    """The counts of many requests as those of one."""
    kind = int(group["kind"][0])
    keys, n = _merged(kind, [np.frombuffer(x, _TYPE[kind]) for x in group["keys"]], [np.frombuffer(x, "<i8") for x in group["counts"]])
    yield _batch([(kind, int(group["bucket"][0]), int(group["salt"][0]), keys.tobytes(), n.tobytes())], REQUESTS)


def _values(kind: int, keys: np.ndarray, n: np.ndarray, order1: np.ndarray) -> bytes:
    return (n if kind == WORDS else log_probabilities(keys, n, order1)).astype(_VALUE[kind]).tobytes()


def _find(group: Group) -> Iterator[pa.RecordBatch]:
    """Requests (without counts) meet their bucket's table."""
    kind, bucket = int(group["kind"][0]), int(group["bucket"][0])
    at = group["chunk"].tolist().index(TABLE)
    table, values = np.frombuffer(group["keys"][at], _TYPE[kind]), np.frombuffer(group["counts"][at], _VALUE[kind])
    yield _batch([(c, kind, bucket, values[_lookup(kind, table, np.frombuffer(x, _TYPE[kind]))].tobytes(), 0, 0) for c, x in zip(group["chunk"].tolist(), group["keys"], strict=True) if c != TABLE], ANSWERS)


TABLE = -1


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int | None = None) -> DataFrame:
    """Token counts, the unigram base score and the model's score of every text; learns from rows that are not ``held_out``."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = min(BUCKETS, max(16, -(-chunks // 4)))
    fan = fan or 16 * buckets  # requests of about 16 chunks' bytes
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def ask(group: Group) -> Iterator[pa.RecordBatch]:
        chunk = int(group["chunk"][0])
        raws, held = group["text"], group["held_out"]
        rows = []
        for kind, (keys, n) in _wanted(raws, [not x for x in held]).items():
            rows += [(kind, b, chunk, keys[at].tobytes(), n[at].astype("<i8").tobytes()) for b, at in _by_bucket(kind, keys, buckets)]
        yield _batch(rows, REQUESTS)

    requests = store(map_groups(dealt, ["chunk"], ask, REQUESTS), "requests")

    def low_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(table, np.frombuffer(keys, "<u4") & 0xFFFF, np.frombuffer(n, "<i8"))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["code", "n"])

    order1 = np.zeros(1 << 16, dtype=np.int64)
    low = requests.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(low_orders, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for r in low.collect():  # at most 65,536 rows
        order1[r["code"]] = r["n"]
    order1 = order1.reshape(256, 256)

    def answer(group: Group) -> Iterator[pa.RecordBatch]:
        """All requests of a bucket: summed up, and answered at once."""
        kind, bucket = int(group["kind"][0]), int(group["bucket"][0])
        asked = [np.frombuffer(x, _TYPE[kind]) for x in group["keys"]]
        keys, total = _merged(kind, asked, [np.frombuffer(x, "<i8") for x in group["counts"]])
        values = np.frombuffer(_values(kind, keys, total, order1), _VALUE[kind])
        rows = [(c, kind, bucket, values[_lookup(kind, keys, x)].tobytes(), 0, 0) for c, x in zip(group["chunk"].tolist(), asked, strict=True)]
        if kind == WORDS:
            rows[0] = (*rows[0][:4], int((total > 0).sum()), int(total.sum()))
        yield _batch(rows, ANSWERS)

    def table(group: Group) -> Iterator[pa.RecordBatch]:
        """The table of a bucket, with an answer to nobody that holds its sums."""
        kind = int(group["kind"][0])
        keys, total = _merged(kind, [np.frombuffer(x, _TYPE[kind]) for x in group["keys"]], [np.frombuffer(x, "<i8") for x in group["counts"]])
        sums = (int((total > 0).sum()), int(total.sum())) if kind == WORDS else (0, 0)
        yield _batch([(kind, int(group["bucket"][0]), keys.tobytes(), _values(kind, keys, total, order1), *sums)], TABLES)

    if chunks <= fan:
        answers = store(map_groups(requests, ["kind", "bucket"], answer, ANSWERS), "answers")
        sums = answers.agg(F.sum("distinct"), F.sum("tokens")).first()
    else:
        merged, left = requests, chunks
        while left > fan:
            left = -(-left // fan)
            merged = store(map_groups(merged.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(left))), ["kind", "bucket", "salt"], _combine, REQUESTS), "requests")
        tables = store(map_groups(merged, ["kind", "bucket"], table, TABLES), "tables")
        sums = tables.agg(F.sum("distinct"), F.sum("tokens")).first()
        salts = -(-chunks // fan)
        salt = F.pmod(F.xxhash64("chunk"), F.lit(salts))
        asked = requests.select("kind", "bucket", salt.alias("salt"), "chunk", "keys", F.lit(None).cast("binary").alias("counts"))
        copies = tables.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(TABLE).cast("long").alias("chunk"), "keys", F.col("data").alias("counts"))
        pairs = asked.unionByName(copies.join(asked.select("kind", "bucket", "salt").distinct(), ["kind", "bucket", "salt"], "left_semi"))
        answers = store(map_groups(pairs, ["kind", "bucket", "salt"], _find, ANSWERS), "answers")
    ends = plain.where(~F.col("held_out")).count()
    tokens, distinct = (sums[1] or 0) + ends, (sums[0] or 0) + (ends > 0)

    rows = dealt.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("text").alias("data"), "doc_id", "held_out")
    rows = rows.unionByName(answers.select("chunk", "kind", "bucket", "data", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")))

    def finish(group: Group) -> Iterator[pa.RecordBatch]:
        kind, bucket, data = group["kind"].tolist(), group["bucket"].tolist(), group["data"]
        docs_at = [i for i, k in enumerate(kind) if k == 0]
        held = group["held_out"]
        ids = group["doc_id"]
        found = {(k, b): x for k, b, x in zip(kind, bucket, data, strict=True) if k}
        known = {}
        for k, (keys, _) in _wanted([data[i] for i in docs_at], [not held[i] for i in docs_at]).items():
            values = np.zeros(len(keys), _VALUE[k])
            for b, at in _by_bucket(k, keys, buckets):
                values[at] = np.frombuffer(found[k, b], _VALUE[k])
            known[k] = keys, values
        base_of = np.log10(tokens + 0.5 * (distinct + 1))
        out = []
        for i in docs_at:
            words, n = _different(WORDS, word_names(data[i]))
            keys, c = known[WORDS]
            count = np.append(c[_lookup(WORDS, keys, words)], ends)  # the end token is the last
            times = np.append(n, 1)
            base = float((times * (np.log10(count + 0.5) - base_of)).sum())
            codes, m = _different(GRAMS, grams(data[i]))
            keys, p = known[GRAMS]
            out.append((ids[i], held[i], int(times.sum()), int(times[count > 0].sum()), base, float((m * p[_lookup(GRAMS, keys, codes)]).sum())))
        yield _batch(out, SCORES)

    return map_groups(rows, ["chunk"], finish, SCORES).withColumn("train_tokens", F.lit(tokens).cast("long"))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
