"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two permutations give a whole signature: the first scatters the shingles, the
second, shifted by one more place for each coordinate, ranks them (C-MinHash).
Bands of ``ROWS`` coordinates make the buckets.  With 32 bands of 4 a pair at the
threshold of 0.75 shares no bucket with a probability of 6e-6.

Documents with equal shingle sets are one class first, named by 128 bits of the
set, so a bucket holds each set once; the text of one row of each is compared.  A bucket is checked on full sets in blocks of about ``BLOCK`` classes: all
pairs of a block, and each block against the bucket's smallest class.  Only the
links of a spanning forest leave a task.  Where a bucket of several blocks still
spans more than one component, its pairs of blocks are checked too; so no link
is lost, and a huge group of mutual copies costs no more than its size.

Defined results: null and empty texts have an empty set and are linked with
nothing; texts may be of any length; rows with equal doc_id and words are one
node, and rows with equal doc_id and different words belong together (each word
set with all that it is similar to); rows with a null doc_id are linked like any
other, their component_id is null where no linked row has an id, and they are
kept only then; an empty table gives an empty table; other columns, whatever
their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, texts
from .groups import Group, components, join_one, map_groups
from .shingles import WORDS, mix, places, shared, shingles

BANDS, ROWS, BLOCK = 32, 4, 512
NUMERATOR = 75
_C = np.uint64(0x9E3779B97F4A7C15)
FEATURES = "doc_id long, row binary, n_shingles long, set binary, bands array<long>"


def permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(found: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k: the least rank of a shingle under the second permutation shifted by k."""
    placed = (found["a"] >> np.uint64(32)).astype(np.uint32)  # the names scatter the shingles
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(placed), 2048):
        out = np.minimum(out, permute(placed[None, at : at + 2048] - shift).min(axis=1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * _C + rows[:, r])
    return h.view(np.int64)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): ``row`` names the id and the text."""
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b":"), "text")))
    return texts(docs, id_col, text_col).select("doc_id", row.alias("row"), "text")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, 128 bits that name the set, and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name, keys = [], [], []
            for raw in batch.column(2):
                s = shingles(raw.as_py(), WORDS)
                n.append(len(s))
                name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(bands(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_shingles", "set", "bands"],
            )

    return rows_of(docs, id_col, text_col).mapInArrow(run, FEATURES)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by a product of the 0/1 matrix of the shingles that occur twice."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    inverse, counts = places(np.concatenate(sets))
    columns = np.cumsum(counts > 1) - 1
    use = counts[inverse] > 1
    owner, column = owner[use], columns[inverse[use]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (1 << 21) // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def forest(sets: list[np.ndarray], label: list) -> list[tuple[int, int]]:
    """Links (100 * common >= 75 * union) between the sets of a group, a spanning forest of them; equal labels are linked already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        c = shared(sets[0], sets[1])
        return [(0, 1)] if label[0] != label[1] and 100 * c >= NUMERATOR * (int(sizes.sum()) - c) else []
    common = overlaps(sets)
    linked = 100 * common >= NUMERATOR * (sizes[:, None] + sizes[None, :] - common)
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(label[i]), root(label[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


LINKS = "a binary, b binary"


def _check(members: DataFrame, source: DataFrame) -> DataFrame:
    """Links within the groups (key, block) of ``members`` (key, block, set, label); ``source`` has the text of each set."""

    def verify(group: Group) -> Iterator[pa.RecordBatch]:
        names, label, raw = group["set"], group["label"], group["text"]
        if len(names) < 2 or len(set(label)) < 2:
            return
        found = forest([shingles(x, WORDS) for x in raw], label)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], names=["a", "b"])

    return map_groups(members.join(source, "set"), ["key", "block"], verify, LINKS)


def classes(found: DataFrame) -> DataFrame:
    """One row per non-empty set: the row whose text is compared, the smallest doc_id, the number of rows and the band keys."""
    own = found.where("n_shingles > 0").groupBy("set").agg(F.min(F.struct("row", "bands")).alias("_c"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    return own.select("set", F.col("_c.row").alias("row"), F.col("_c.bands").alias("bands"), "least", "rows")


def _same_id(found: DataFrame) -> DataFrame:
    """Links between the sets of rows with equal doc_id, each set with the smallest of its id."""
    own = found.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set").distinct()
    least = own.groupBy("doc_id").agg(F.min("set").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    return join_one(own, least, "doc_id").where("a != set").select("a", F.col("set").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    found = store(features(docs, id_col, text_col), "features")
    sets = store(classes(found), "classes")
    keyed = sets.select(F.explode("bands").alias("key"), "set")
    # Buckets with the same members (most pairs share several bands) are checked once.
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("set")).alias("centre"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")).where("n > 1")
    sized = sized.groupBy("n", "centre", "x", "y").agg(F.min("key").alias("key")).drop("x", "y")
    # Blocks of about BLOCK members; the bucket's smallest class is in each of them.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = keyed.join(sized, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("set"), F.col("blocks"))
    member = member.select("key", "set", "blocks", F.when(F.xxhash64("set") == F.col("centre"), F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).otherwise(F.array(own)).alias("in"))
    member = store(member.select("key", F.explode("in").alias("block"), "set", "blocks"), "members")
    # The candidates grow with the corpus, so they are merged at every size and never broadcast.
    wanted = sets.select("set", "row").join(member.select("set").distinct().hint("merge"), "set", "left_semi")
    source = rows_of(docs, id_col, text_col).select("row", "text").join(wanted.hint("merge"), "row").dropDuplicates(["row"])  # rows may repeat, their texts are equal then
    source = store(source.select("set", "text"), "candidates")
    links = store(_check(member.select("key", "block", "set", F.col("set").alias("label")), source).unionByName(_same_id(found)), "links")
    of = components(links)
    large = member.where("blocks > 1").drop("blocks").distinct()
    if large.limit(1).count():
        labelled = large.join(of.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
        open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), (F.max("block") + 1).alias("blocks")).where("lo < hi").select("key", "blocks")
        # Every pair of blocks is a group; a member is in the pairs of its own block.
        pairs = labelled.join(open_, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other != block")
        pairs = pairs.select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("block"), "set", "label")
        of = components(links.unionByName(_check(pairs, source)))
    # The smallest doc_id of each component, for the sets that are linked; any other set has its own.
    linked = store(sets.select("set", "least", "rows").join(of.withColumnRenamed("node", "set"), "set", "left"), "linked")
    ids = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("id"), F.count("*").alias("rows"))
    joined = join_one(linked.where("component is not null").withColumnRenamed("rows", "n"), ids, "component")
    of_set = joined.select("set", "id", F.col("n").alias("rows")).unionByName(linked.where("component is null").select("set", F.col("least").alias("id"), "rows"))
    full = join_one(found.where("n_shingles > 0").select("doc_id", "n_shingles", "set"), of_set, "set")
    none = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("id"))
    return full.select("doc_id", "n_shingles", "id").unionByName(none).select("doc_id", "n_shingles", F.col("id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("id")).alias("kept"))
