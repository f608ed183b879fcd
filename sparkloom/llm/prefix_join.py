"""Sets of word shingles of a Jaccard similarity of 0.8 or more: a grouped prefix join.

Two sets that are similar enough share a shingle among the first ``n - ceil(0.8 n) + 1``
of each, in any one order of all shingles.  Here the order is by frequency, the
rarest first, so what stands in many texts hardly ever starts a set.

* A task reads a block of documents and sends each different shingle of a block
  once, as 32 bits beside the number of its bucket (a bucket is a range of shingle
  hashes): with the set that has it, or with a count if several sets of the block have it.
  So a shingle that is in every document costs a bucket one entry a block.
* A bucket adds up frequencies and answers only shingles that occur twice.  (Shingles
  that agree in these bits count as one; this changes the order for all sets alike,
  so no link is lost.)
* A block then knows how many shingles of a set occur nowhere else.  Sets with more
  of these than their prefix holds have no partner.  Of the others the rest of the
  prefix is known.
* Sets of equal size and prefix become one group.  Groups that share a prefix shingle
  and whose sizes allow a link are candidates; their connected components are the units of
  checking.  In a unit pairs of groups are filtered by prefix and size, then expanded, and the full
  sets of the members are compared by 128-bit names; the links of a spanning forest
  leave a task.  Units of more than ``BLOCK`` sets or ``WEIGHT`` shingles are checked by
  shared shingle instead, in blocks that all hold the smallest set, and in all
  pairs of blocks where that leaves several components.

Defined results: null and empty texts, and texts without words, have an empty set
and are linked with nothing; fewer than five words are one shingle; texts may be of
any length (a text must fit in a task); rows with equal doc_id and words are one
node, and rows with equal doc_id and different words belong together; rows with a
null doc_id are linked like any other, their component_id is null where no linked row
has an id; an empty table gives an empty table; other columns, whatever their names,
do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, partitions, store
from .divergence import slices
from .groups import Group, components, join_one, map_groups
from .minhash import overlaps, rows_of
from .shingles import NAME, WORDS, shared, shingles

NUMERATOR = 80
SLICE, MAX_SETS = 16 << 20, 1 << 15
BLOCK, WEIGHT = 512, 4 << 20
#: bucket >= 0: shingles asked for or answered; below: the documents and the sets of a block.
ROWS = "bucket long, block long, doc_id long, row binary, n_shingles long, set binary, bits binary, owner binary, counts binary"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of size n to compare: n - ceil(0.8 n) + 1."""
    return n + (-NUMERATOR * n) // 100 + 1


def _batch(n: int, **columns) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "doc_id": pa.int64(), "n_shingles": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), kinds.get(c, pa.binary())) for c in _NAMES], names=_NAMES)


def asked(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Documents, sets and shingles of each block; 2 ** ``bits`` buckets."""
    buckets = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, SLICE):
                for at in range(0, part.num_rows, MAX_SETS):
                    yield from of_block(part.slice(at, MAX_SETS), task << 32 | count, -1 - (task + 17 * count) % buckets)
                    count += 1

    def of_block(part: pa.RecordBatch, block: int, home: int) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        names, sizes, found = [], [], []
        for raw in part.column(2):
            s = shingles(raw.as_py(), WORDS)
            names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sizes.append(len(s))
            if len(s) and names[-1] not in number:
                number[names[-1]] = len(number)
                found.append(s["b"].copy())
        m = part.num_rows
        spread = [-1 - int.from_bytes(name[:8], "little") % buckets for name in part.column(1).to_pylist()]
        yield _batch(m, bucket=spread, block=[block] * m, doc_id=part.column(0).cast(pa.int64()), row=part.column(1), n_shingles=sizes, set=names)
        if not found:
            return
        lengths = np.array([len(x) for x in found])
        token = np.concatenate(found)
        owner = np.repeat(np.arange(len(found), dtype=np.uint16), lengths)
        order = np.argsort(token >> np.uint64(32 - bits), kind="stable")
        cut = (token >> np.uint64(32 - bits))[order]
        first = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
        times = np.diff(np.append(first, len(cut)))
        once = np.zeros(len(token), dtype=bool)
        once[order[first[times == 1]]] = True
        several = order[np.repeat(times > 1, times)]
        # the sets of the block, and who has the shingles that stand in several
        yield _batch(1, bucket=[home], block=[block], set=[b"".join(number)], bits=[token[several].tobytes()], owner=[owner[several].tobytes()], counts=[lengths.astype(np.int64).tobytes()])
        token, owner = token[once], owner[once]
        bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")  # within a bucket by owner, which compresses
        rest, owner = (token[by] >> np.uint64(32 - bits)).astype(np.uint32), owner[by]
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        often, often_n = cut[first[times > 1]], times[times > 1].astype(np.uint32)
        often_at = np.searchsorted(often >> np.uint64(32), np.arange(buckets + 1))
        often = often.astype(np.uint32)
        use = np.flatnonzero((edges[1:] > edges[:-1]) | (often_at[1:] > often_at[:-1]))
        cuts = [(slice(edges[b], edges[b + 1]), slice(often_at[b], often_at[b + 1])) for b in use]
        yield _batch(
            len(use), bucket=use, block=[block] * len(use),
            bits=[rest[a].tobytes() + often[b].tobytes() for a, b in cuts], owner=[owner[a].tobytes() for a, _ in cuts], counts=[often_n[b].tobytes() for _, b in cuts],
        )

    return rows_of(docs, id_col, text_col).mapInArrow(run, ROWS)


def answer(group: Group) -> Iterator[pa.RecordBatch]:
    """A bucket: of the shingles that occur twice, to each block the frequencies; rows of documents and sets pass."""
    bucket = int(group["bucket"][0])
    m = len(group["bucket"])
    if bucket < 0:
        yield _batch(m, **{c: (v if isinstance(v, list) else pa.array(v)) for c, v in group.items()})
        return
    rest = [np.frombuffer(x, np.uint32) for x in group["bits"]]
    counts = [np.frombuffer(x, np.uint32) for x in group["counts"]]
    owners = [np.frombuffer(x, np.uint16) for x in group["owner"]]
    token = np.concatenate(rest)
    weight = np.concatenate([np.concatenate((np.ones(len(o), dtype=np.int64), c)) for o, c in zip(owners, counts, strict=True)])
    order = np.argsort(token, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], token[order][1:] != token[order][:-1])))
    total = np.empty(len(token), dtype=np.int64)
    total[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(token))))
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    out, at = [], 0
    for block, r, o in zip(group["block"], rest, owners, strict=True):
        mine, n = total[at : at + len(r)], len(o)
        at += len(r)
        single = np.flatnonzero(mine[:n] > 1)
        if len(single) or len(r) > n:
            out.append((int(block), np.concatenate((r[:n][single], r[n:])), o[single], np.concatenate((mine[:n][single], mine[n:]))))
    yield _batch(len(out), bucket=[bucket] * len(out), block=[x[0] for x in out], bits=[x[1].tobytes() for x in out], owner=[x[2].tobytes() for x in out], counts=[x[3].tobytes() for x in out])


SETS = "set binary, n long, grp binary, tokens array<long>"


def prefixes(answers: DataFrame, bits: int) -> DataFrame:
    """(set, n, grp, tokens) of the sets that may have partners: the part of the prefix that others have; ``grp`` names size and prefix."""

    def of_block(group: Group) -> Iterator[pa.RecordBatch]:
        own = [i for i, b in enumerate(group["bucket"]) if b < 0]
        i = own[0]
        n = np.frombuffer(group["counts"][i], np.int64)
        several, their = np.frombuffer(group["bits"][i], np.uint64) >> np.uint64(32 - bits), np.frombuffer(group["owner"][i], np.uint16)
        token, owner, total, often, often_total = [], [], [], [], []
        for b, raw, who, count in zip(group["bucket"], group["bits"], group["owner"], group["counts"], strict=True):
            if b < 0:
                continue
            t = np.frombuffer(raw, np.uint32).astype(np.uint64) | np.uint64(int(b)) << np.uint64(32)
            o, c = np.frombuffer(who, np.uint16), np.frombuffer(count, np.uint32)
            token.append(t[: len(o)])
            owner.append(o)
            total.append(c[: len(o)])
            often.append(t[len(o) :])
            often_total.append(c[len(o) :])
        if not token:
            return
        often, often_total = np.concatenate(often), np.concatenate(often_total)
        at = np.argsort(often)
        token.append(several)
        owner.append(their)
        total.append(often_total[at][np.searchsorted(often[at], several)])
        token, owner, total = np.concatenate(token), np.concatenate(owner), np.concatenate(total)
        need = prefix_length(n) - (n - np.bincount(owner, minlength=len(n)))
        use = need[owner] > 0
        token, owner, total = token[use], owner[use], total[use]
        order = np.lexsort((token, total, owner))
        token, owner = token[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(n) + 1))
        sets = group["set"][i]
        names, sizes, groups, tokens = [], [], [], []
        for k in np.flatnonzero(need > 0):
            mine = token[edges[k] : min(edges[k] + need[k], edges[k + 1])].astype(np.int64)
            names.append(sets[16 * k : 16 * k + 16])
            sizes.append(int(n[k]))
            groups.append(hashlib.blake2b(mine.tobytes() + int(n[k]).to_bytes(8, "little"), digest_size=16).digest())
            tokens.append(np.unique(mine))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(groups, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], names=["set", "n", "grp", "tokens"])

    wanted = answers.where("doc_id is null and row is null").select("block", "bucket", "set", "bits", "owner", "counts")
    return map_groups(wanted, ["block"], of_block, SETS)


LINKS = "a binary, b binary"


def forest(group: Group) -> list[tuple[bytes, bytes]]:
    """Links of a spanning forest of a unit; equal labels are linked already."""
    names, label = group["set"], group["label"]
    if len(names) < 2 or len(set(label)) < 2:
        return []
    sizes = np.array(group["n"], dtype=np.int64)
    may = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= NUMERATOR * np.maximum(sizes[:, None], sizes[None, :])
    # groups of equal size and prefix; pairs of groups that share a prefix shingle
    kinds = {g: i for i, g in enumerate(dict.fromkeys(group["grp"]))}
    kind = np.array([kinds[g] for g in group["grp"]])
    heads = [np.zeros(0, NAME)] * len(kinds)
    for g, t in zip(kind, group["tokens"], strict=True):
        heads[g] = np.zeros(len(t), NAME)
        heads[g]["a"] = np.array(t, dtype=np.int64).view(np.uint64)
    near = overlaps(heads) > 0
    may &= near[kind[:, None], kind[None, :]] | (kind[:, None] == kind[None, :])
    np.fill_diagonal(may, False)
    use = np.flatnonzero(may.any(axis=1))
    if not len(use):
        return []
    sets = [shingles(group["text"][i], WORDS) for i in use]
    assert [len(s) for s in sets] == sizes[use].tolist()
    both = sizes[use][:, None] + sizes[use][None, :]
    common = np.array([[0, c := shared(*sets)], [c, 0]]) if len(use) == 2 else overlaps(sets)
    linked = may[np.ix_(use, use)] & (100 * common >= NUMERATOR * (both - common))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(label[use[i]]), root(label[use[j]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((names[use[i]], names[use[j]]))
    return out


def verify(group: Group) -> Iterator[pa.RecordBatch]:
    found = forest(group)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


OF = "node binary, component binary"


def settle(group: Group) -> Iterator[pa.RecordBatch]:
    """The components of a whole unit: (node, component), the smallest set of each; sets without a link are left out."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in forest(group):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["node", "component"])


def _keyed(members: DataFrame) -> DataFrame:
    """(key, rep): the prefix shingles of each group, once in its range of sizes and once in the next, so that sizes that allow a link meet."""
    groups = members.groupBy("grp").agg(F.min("set").alias("rep"), F.min(F.struct("n", "tokens")).alias("_g"))
    scale = F.floor(F.log("_g.n") / math.log(1.26))
    return groups.select("rep", scale.alias("scale"), F.explode("_g.tokens").alias("token")).select("rep", F.explode(F.array(F.xxhash64("token", "scale"), F.xxhash64("token", F.col("scale") + 1))).alias("key"))


def _stars(keyed: DataFrame) -> DataFrame:
    least = keyed.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    return join_one(keyed, least, "key").where("a != rep").select("a", F.col("rep").alias("b")).distinct()


def _large(members: DataFrame, source: DataFrame) -> DataFrame:
    """(node, component) of the ``members`` of units that no task can hold."""
    reps = members.groupBy("grp").agg(F.min("set").alias("rep"), F.count("*").alias("rows"))
    held = join_one(members.select("grp", "set", "n"), reps, "grp")  # (grp, set, n, rep)
    by_token = _keyed(members).join(held.groupBy("rep").agg(F.count("*").alias("rows")), "rep")
    keyed = by_token.select("key", "rep").join(held.select("rep", "set", "n"), "rep").select("key", "set", "n").distinct()
    mark = F.xxhash64("set")
    sized = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("w"), F.min(mark).alias("centre"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")).where("rows > 1")
    sized = sized.groupBy("rows", "w", "centre", "x", "y").agg(F.min("key").alias("key")).withColumn("blocks", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("w") / WEIGHT)).cast("long"))
    member = keyed.join(sized.select("key", "centre", "blocks"), "key")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    member = member.select("key", "set", "blocks", F.explode(F.when(mark == F.col("centre"), every).otherwise(F.array(F.pmod(F.xxhash64("set", F.lit(2)), F.col("blocks"))))).alias("block"))
    member = store(member, "large")
    links = store(map_groups(member.select("key", "block", "set", F.col("set").alias("label")).join(source, "set"), ["key", "block"], verify, LINKS), "large-links")
    of = store(components(links, "large-edges"), "large-of")
    labelled = member.where("blocks > 1").join(of.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    pairs = labelled.join(open_, "key").withColumn("other", F.explode(every)).where("other != block")
    pairs = pairs.select("key", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("block"), "set", "label")
    more = store(map_groups(pairs.join(source, "set"), ["key", "block"], verify, LINKS), "large-more")
    return components(links.unionByName(more), "large-edges") if more.limit(1).count() else of


def _same_id(found: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` (node, component) with components joined where rows of one doc_id have several sets."""
    own = found.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set").distinct()
    least = own.groupBy("doc_id").agg(F.min("set").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    edges = store(join_one(own, least, "doc_id").where("a != set").select("a", F.col("set").alias("b")), "same-id")
    if not edges.limit(1).count():
        return of
    for end in ("a", "b"):
        edges = edges.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    top = store(components(edges, "id-edges"), "top")
    up = top.select(F.col("node").alias("component"), F.col("component").alias("_up"))
    lifted = of.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return lifted.unionByName(top.join(of.select("node"), "node", "left_anti"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    bits = max(1, math.ceil(math.log2(partitions(docs.sparkSession))))
    answers = store(map_groups(asked(docs, id_col, text_col, bits), ["bucket"], answer, ROWS), "answers")
    found = store(answers.where("row is not null").select("doc_id", "row", "n_shingles", "set"), "found")
    members = store(prefixes(answers, bits).dropDuplicates(["set"]), "prefixes")
    drop_stored("answers")
    in_group = members.groupBy("grp").agg(F.min("set").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    inside = join_one(members.select("grp", F.col("set").alias("b")), in_group, "grp").where("a != b").select("a", "b")
    units = components(store(_stars(_keyed(members)).unionByName(inside), "candidates"), "units").select(F.col("node").alias("set"), F.xxhash64("component").alias("key"))
    open_ = store(members.join(units, "set"), "open")
    wanted = found.where("n_shingles > 0").groupBy("set").agg(F.min("row").alias("row")).join(open_.select("set"), "set", "left_semi")
    text = rows_of(docs, id_col, text_col).select("row", "text").join(wanted.hint("merge"), "row").dropDuplicates(["set"]).select("set", "text")
    source = store(open_.drop("key").join(text, "set"), "texts", "zstd")
    size = store(open_.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("w")), "sizes")
    fits = (F.col("rows") <= BLOCK) & (F.col("w") <= WEIGHT)
    small = open_.select("key", "set").join(size.where(fits).select("key"), "key").select("key", "set", F.col("set").alias("label"))
    of = map_groups(small.join(source, "set"), ["key"], settle, OF)
    large = size.where(~fits).select("key")
    if large.limit(1).count():
        of = of.unionByName(_large(open_.join(large, "key").drop("key"), source))
    of = _same_id(found, store(of, "settled"))
    sets = found.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = store(sets.join(of.withColumnRenamed("node", "set"), "set", "left"), "linked")
    ids = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("id"), F.count("*").alias("rows"))
    joined = join_one(linked.where("component is not null").withColumnRenamed("rows", "n"), ids, "component")
    of_set = joined.select("set", "id", F.col("n").alias("rows")).unionByName(linked.where("component is null").select("set", F.col("least").alias("id"), "rows"))
    full = join_one(found.where("n_shingles > 0").select("doc_id", "n_shingles", "set"), of_set, "set")
    none = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("id"))
    return full.select("doc_id", "n_shingles", "id").unionByName(none).withColumnRenamed("id", "component_id")
