"""Groups of rows in Python without a call per group, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, unused


Group = dict[str, "np.ndarray | list"]


def _plain(column: pa.Array) -> np.ndarray | list:
    """Numbers without nulls as an array, anything else as a list."""
    if column.null_count == 0 and pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.to_pylist()


def _joined(parts: list[Group]) -> Group:
    if len(parts) == 1:
        return parts[0]
    out: Group = {}
    for name in parts[0]:
        own = [p[name] for p in parts]
        out[name] = np.concatenate(own) if all(isinstance(x, np.ndarray) for x in own) else [y for x in own for y in (x.tolist() if isinstance(x, np.ndarray) else x)]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Group]:
    """Consecutive rows with equal values in the first ``keys`` (integer, not null) columns, also across batches; columns by name."""
    held: list[Group] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: _plain(batch.column(i)) for i, n in enumerate(batch.schema.names)}
        by = list(columns.values())[:keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in by:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(c[a] for c in by)
            if held and now != last:
                yield _joined(held)
                held = []
            held.append({n: c[a:b] for n, c in columns.items()})
            last = now
    if held:
        yield _joined(held)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[Group], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over each group of equal integer ``keys``; a group must fit in a task."""

    def each(groups: Iterator[Group]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            yield from fn(group)

    return map_all_groups(df, keys, each, schema)


def map_all_groups(df: DataFrame, keys: list[str], fn: Callable[[Iterator[Group]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over the groups of a task one after another, so that small ones can share a batch of results."""
    ordered = df.select(*keys, *[c for c in df.columns if c not in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(runs(batches, len(keys)))

    return ordered.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


HOT_SHARE = 2000


def join_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner", rows: str = "rows") -> DataFrame:
    """``many`` joined with ``one``, which has a row a key and the column ``rows``: how many rows of ``many`` have that key.

    Keys with at least 1 / ``HOT_SHARE`` of the rows that ``one`` knows are
    ``HOT_SHARE`` at most; they are broadcast, so no task gets more than that
    share of one of them.
    """
    one = store(one, "one")
    total = one.agg(F.sum(rows)).first()[0] or 0
    bound = max(1000, total // HOT_SHARE)
    hot = one.where(F.col(rows) >= bound)  # at most HOT_SHARE rows
    mark = unused(many, "_hot")
    marked = many.join(F.broadcast(hot.select(key, F.lit(True).alias(mark))), key, "left")
    common = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot), key)
    return marked.where(F.col(mark).isNull()).drop(mark).join(one.where(F.col(rows) < bound).hint("merge"), key, how).unionByName(common).drop(rows)


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the smallest node reachable.

    Large-star and small-star steps in turn until nothing moves; every step is
    aggregates and joins, and its edges are stored, so no lineage grows.
    """

    def least_of(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))

    now = store(edges.select(F.least("a", "b").alias("m"), F.greatest("a", "b").alias("v")).where("m < v").distinct(), name)
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("m", "v").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        both = now.select(F.col("m").alias("u"), "v").unionByName(now.select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = least_of(both).withColumn("m", F.least("u", "m"))
        large = store(join_one(both, least, "u").where("v > u").select("m", "v").where("m < v").distinct(), f"{name}-large")
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least_of(down)
        small = join_one(down, least, "u").where("v > m").select("m", "v").unionByName(least.select("m", F.col("u").alias("v"))).distinct()
        now = store(small, name)
    stars = now.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return stars.unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
