"""Graph operators over edge tables.

Loops run on the driver, data does not: each round is joins and aggregates over
edges, and its result is written where a lost executor can read it again.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_stored, scratch, store

# What an edge of a kind weighs in ranking.
KIND_WEIGHT = {"imports": 1.0, "calls": 1.0, "inherits": 1.5, "references": 0.6, "depends": 0.3, "contains": 0.5, "co_change": 0.4}


def cut(df: DataFrame, name: str = "graph") -> DataFrame:
    """Write and reread in the shared folder, so that a loop's plan stays short."""
    return store(df, name)


def structural(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight) in both directions with the weights of ranking."""
    table = F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])
    w, k = F.coalesce("weight", F.lit(1.0)), table[F.col("kind")]
    there = F.when(F.col("kind") == "contains", 0.5 * w).when(F.col("kind") == "co_change", 0.4 * w).otherwise(k * w)
    back = F.when(F.col("kind") == "contains", 0.25 * w).when(F.col("kind") == "co_change", 0.4 * w).otherwise(0.08 * k * w)
    # the two directions of a pair share a row until their edges are summed; a null end comes first
    ahead = F.coalesce(F.col("src") <= F.col("dst"), F.col("src").isNull())
    low, high = F.when(ahead, F.col("src")).otherwise(F.col("dst")), F.when(ahead, F.col("dst")).otherwise(F.col("src"))
    pairs = edges.where(k.isNotNull()).select(low.alias("a"), high.alias("b"), F.when(ahead, there).otherwise(back).alias("ab"), F.when(ahead, back).otherwise(there).alias("ba"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    one, other = (F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), w.alias("weight")) for s, d, w in (("a", "b", F.col("ab")), ("b", "a", F.col("ba"))))
    loop = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("ab") + F.col("ba")).alias("weight")))
    return pairs.select(F.explode(F.when(F.col("a").eqNullSafe(F.col("b")), loop).otherwise(F.array(one, other))).alias("e")).select("e.src", "e.dst", "e.weight")


def strongest(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind), the heaviest; no loops."""
    return edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def diff(active: DataFrame, desired: DataFrame, least: float = 1e-6) -> DataFrame:
    """What to open, close or reweigh."""
    a, d = active.select("src", "dst", "kind", F.col("weight").alias("old")), desired.select("src", "dst", "kind", F.col("weight").alias("new"))
    action = F.when(F.col("old").isNull(), "open").when(F.col("new").isNull(), "close").when(F.abs(F.col("new") - F.col("old")) > least, "reweigh")
    return a.join(d, ["src", "dst", "kind"], "full_outer").withColumn("action", action).where("action is not null")


def as_of(edges: DataFrame, ts) -> DataFrame:
    """The edges valid at a time."""
    return edges.where((F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, personal: DataFrame | None = None, d: float = 0.85, tol: float = 1e-8) -> DataFrame:
    """(id, rank) when a step moves less than ``tol`` in sum, or after just ``rounds`` steps if given; the mass of nodes without edges goes back by the teleport weights."""
    ids = nodes.select("id").distinct()
    weight = ids.withColumn("p", F.lit(1.0)) if personal is None else ids.join(personal.select("id", "p"), "id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    total = weight.agg(F.sum("p"), F.count("*")).first()
    if not total[1]:
        return ids.withColumn("rank", F.lit(0.0))
    p = weight.withColumn("p", F.col("p") / total[0] if total[0] else F.lit(1.0 / total[1]))
    work = scratch("pagerank")
    used = edges.where("weight > 0").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = used.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(used.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), work)
    p = cut(p.join(out.select(F.col("src").alias("id"), F.lit(True).alias("linked")), "id", "left"), work)
    rank = p.select("id", F.col("p").alias("rank"))
    for k in itertools.count():  # each step shrinks the distance by d
        if k == rounds:
            break
        before = rank
        lost = p.where("linked is null").join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = share.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = p.join(got, "id", "left").crossJoin(F.broadcast(lost))  # one row
        rank = new.select("id", ((1 - d) * F.col("p") + d * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("rank"))
        if k % 3 == 2:
            rank = cut(rank, work)
            if rounds is None and rank.join(before.withColumnRenamed("rank", "was"), "id").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("was"))), F.lit(0.0))).first()[0] < tol:
                break
    drop_stored(work, but=rank)
    return rank


def focused_rank(nodes: DataFrame, edges: DataFrame, focus: DataFrame, tol: float = 1e-8) -> DataFrame:
    """0.75 of the rank personalised to ``focus`` (id, p) and 0.25 of the global rank, each over its maximum."""

    def scaled(rank: DataFrame, name: str) -> DataFrame:
        most = rank.agg(F.max("rank").alias("most"))  # one row
        return rank.crossJoin(F.broadcast(most)).select("id", F.coalesce(F.try_divide("rank", "most"), F.lit(0.0)).alias(name))

    own, every = (scaled(pagerank(nodes, edges, personal=p, tol=tol), name) for p, name in ((focus, "own"), (None, "every")))
    return own.join(every, "id").select("id", (0.75 * F.col("own") + 0.25 * F.col("every")).alias("rank"))


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, level) of what is reached over src -> dst within ``depth`` steps, the first level counts."""
    work = scratch("levels")
    seen = start.select("id").distinct().withColumn("level", F.lit(0).cast("long"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("level", F.lit(k).cast("long")), work)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def impact(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """What depends on the start, by levels."""
    return levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_path(edges: DataFrame, a, b, most: int | None = None) -> list:
    """A shortest undirected path, of equal ones that over the smallest ids; empty if there is none (with ``most``: none of so many steps)."""
    spark, work = edges.sparkSession, scratch("path")
    both = undirected(edges)
    kind = both.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(a, None)], f"id {kind}, before {kind}")
    front = seen
    for _ in itertools.count() if most is None else range(most):
        if not seen.where(F.col("id") == F.lit(b)).isEmpty():
            break
        step = front.join(both, front["id"] == both["src"]).groupBy("dst").agg(F.min("src").alias("before")).withColumnRenamed("dst", "id")
        front = cut(step.join(seen, "id", "left_anti"), work)
        if front.isEmpty():
            drop_stored(work)
            return []
        seen = cut(seen.unionByName(front), work)
    path, at = [], b
    while at is not None:  # a row for each step is looked up
        row = seen.where(F.col("id") == F.lit(at)).first()
        if row is None:
            path = []
            break
        path.append(at)
        at = row["before"]
    drop_stored(work)
    return path[::-1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (src, dst): the smallest node reached.

    Each node is tied to the smallest one that it or its neighbours know, larger and
    smaller neighbours in turn, until nothing moves; the number of edges never grows.
    """
    work = scratch("components")
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    now = cut(edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).where("low < high").distinct(), work)
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = now.select(F.col("low").alias("id"), F.col("high").alias("near")).unionByName(now.select(F.col("high").alias("id"), F.col("low").alias("near")))
        least = both.groupBy("id").agg(F.min("near").alias("least")).select("id", F.least("id", "least").alias("least"))
        wide = cut(both.where("near > id").join(least, "id").select(F.col("least").alias("low"), F.col("near").alias("high")).where("low < high").distinct(), work)
        lowest = wide.groupBy("high").agg(F.min("low").alias("least"))
        down = wide.join(lowest, "high").where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        now = cut(down.unionByName(lowest.select(F.col("least").alias("low"), "high")).distinct(), work)
    out = ids.join(now.select(F.col("high").alias("id"), "low"), "id", "left").select("id", F.coalesce("low", "id").alias("component"))
    drop_stored(work, but=now)
    return out


def communities(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """G7-G9 by weighted label propagation: a node takes the label of the greatest weight around it if that is smaller than its own.

    The sequential local-move method depends on an order of all nodes; this one
    is the same in any order and needs a join and two aggregates a round.  Labels
    only fall, so it ends; ``rounds`` stops it before no label moves.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    work = scratch("communities")
    both = cut(both, work)
    label = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in itertools.count() if rounds is None else range(rounds):
        votes = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        own = label.select(F.col("id").alias("src"), "label", F.lit(1e-6).alias("w"))
        best = votes.unionByName(own).groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("best"))
        new = cut(label.join(best.withColumnRenamed("src", "id"), "id").select("id", F.least("label", "best").alias("label"), (F.col("best") < F.col("label")).alias("moved")), work)
        label = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    drop_stored(work, but=label)
    return label
