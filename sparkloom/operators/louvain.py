"""Communities by modularity: local moves in the order of ids, level by level.

Moves never leave a connected component, and only the total weight of the graph
enters from outside; so every component is solved alone, by the sequential
method, in the order of ids, and the result is that of one walk through all
nodes, whatever the size of a component.  A walk is one task by nature: it keeps a few
numbers a node and reads the edges in their order, of a component of more than
``task_edges`` edges from a file of its own.

A community is named by its smallest node.  Defined results: edges are undirected, equal
ones add up, loops count once; weights at most 0 and null ends are left out; nodes
without edges are communities of their own; no edges give each node its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_stored, scratch
from . import walk
from .graph import KIND_WEIGHT, components, cut
from .walk import LEVELS

# Steps to an owner, the kinds of nodes that own what they contain, and the edges of a component that a task keeps in memory.
HOPS = 5
OWNERS = ["file", "class", "struct", "interface", "trait", "object", "module"]
TASK_EDGES = 2_000_000


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions, summed; a loop once."""
    used = edges.where("weight > 0 and src is not null and dst is not null").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    one, other = (F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight") for a, b in (("src", "dst"), ("dst", "src")))
    there = F.when(F.col("src") == F.col("dst"), F.array(one)).otherwise(F.array(one, other))  # a union would make the edges twice
    return used.select(F.inline(there)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _alone(both: DataFrame, of: DataFrame, gamma: float, total: float, levels: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, community) of the components in ``of`` (id, component), each solved in one task; a community is named by its smallest node."""
    kind = both.schema["src"].dataType.simpleString()

    def solved(batches):
        for ids, near in _received(batches, task_edges):
            part = walk.solve(near, gamma, total, levels)
            for k in range(0, len(ids), walk.BLOCK):
                yield pa.RecordBatch.from_arrays([ids[k : k + walk.BLOCK], ids.take(pa.array(part[k : k + walk.BLOCK]))], ["id", "community"])

    # a given number of partitions: by their bytes, which are few, the components would end in one task; by a hash, or the window's partitions would stay, merged by their bytes
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = of.select("component", "id", (F.row_number().over(Window.partitionBy("component").orderBy("id")) - 1).cast("long").alias("n"))
    a, b = nodes.select(F.col("id").alias("src"), "component", F.col("n").alias("a")), nodes.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    edges = both.join(a, "src").join(b, "dst").select("component", "a", "b", "weight", F.lit(None).cast(kind).alias("id"))
    rows = edges.unionByName(nodes.select("component", F.col("n").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("weight"), "id"))
    rows = rows.repartition(parts, F.xxhash64("component")).sortWithinPartitions("component", F.col("b") >= 0, "a", "b")  # the nodes of a component, then its edges
    return rows.select("a", "b", "weight", "id").mapInArrow(solved, f"id {kind}, community {kind}")


def _received(batches: Iterator[pa.RecordBatch], task_edges: int) -> Iterator[tuple[pa.Array, walk.Near]]:
    """The ids of the nodes, and the edges, of one component after the other."""
    ids, near = [], None

    def whole():
        got = pa.concat_arrays(ids)
        return got, near or walk.Near(len(got), task_edges)

    for batch in batches:
        a, b, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        begin = np.flatnonzero((a == 0) & (b < 0)).tolist()
        for new, k, end in zip([False, *[True] * len(begin)], [0, *begin], [*begin, len(a)]):
            if new and ids:
                yield whole()
                ids, near = [], None
            first = k + int((b[k:end] < 0).sum())  # the first edge
            if first > k:
                ids.append(batch.column(3).slice(k, first - k))
            if end > first:
                if near is None:
                    near = walk.Near(sum(map(len, ids)), task_edges)
                near.add(a[first:end], b[first:end], weight[first:end])
    if ids:
        yield whole()


def louvain(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, levels: int = LEVELS, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, community) of the nodes of ``edges`` (src, dst, weight) and of ``nodes`` (id)."""
    work = scratch("louvain")
    both = cut(symmetric(edges), work)
    total = both.agg(F.sum("weight")).first()[0]
    ids = both.select(F.col("src").alias("id")).distinct()
    every = ids if nodes is None else ids.unionByName(nodes.select("id").distinct()).distinct()
    if not total:
        return every.withColumn("community", F.col("id"))
    of = cut(components(both.where("src <= dst")), work)
    found = _alone(both, of, resolution, total, levels, task_edges)
    out = cut(every.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community")), work)
    drop_stored(work, but=out)
    return out


def modularity(edges: DataFrame, of: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of (id, community)."""
    both = symmetric(edges)
    a, b = (of.select(F.col("id").alias(c), F.col("community").alias(f"_{c}")) for c in ("src", "dst"))
    rows = both.join(a, "src").join(b, "dst")
    by = rows.groupBy(F.col("_src").alias("community")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    return by.agg((F.sum("inside") / F.sum("k") - resolution * F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("modularity"))


def owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file): the file that each node (id, kind) belongs to, over at most five steps of contains edges; of several holders the smallest."""
    kinds = nodes.select("id", "kind")
    held = edges.where("kind = 'contains'").join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("_s")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("_d")), "dst")
    held = held.where(F.col("_s").isin(OWNERS) & ~F.col("_d").isin("file", "dir")).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
    held = cut(held, "held")  # else each step would read all nodes and edges
    files = kinds.where("kind = 'file'").select("id", F.lit(True).alias("_file"))
    at = held
    for _ in range(HOPS):
        above = held.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        at = at.join(above, "up", "left").select("id", F.coalesce("_next", "up").alias("up"))
    found = at.join(files.select(F.col("id").alias("up"), "_file"), "up", "left_semi").select("id", F.col("up").alias("file"))
    return files.select("id", F.col("id").alias("file")).unionByName(found)


def coupling(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): how strongly files are tied by the edges (src, dst, kind, weight) of what they hold; ``of``: their owners, if known."""
    table = F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])
    of = owners(nodes, edges) if of is None else of
    used = edges.where((F.col("kind") != "contains") & F.col("kind").isin(list(KIND_WEIGHT)))
    rows = used.join(of.select(F.col("id").alias("src"), F.col("file").alias("_a")), "src").join(of.select(F.col("id").alias("dst"), F.col("file").alias("_b")), "dst").where("_a <> _b")
    return rows.groupBy(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).agg(F.sum(F.coalesce("weight", F.lit(1.0)) * table[F.col("kind")]).alias("weight"))


def file_communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, community) of files by coupling, and of what they hold by its file."""
    of = cut(owners(nodes, edges), "owners")
    part = louvain(coupling(nodes, edges, of), of.select(F.col("file").alias("id")), resolution)
    return of.join(part.withColumnRenamed("id", "file"), "file").select("id", "community")
