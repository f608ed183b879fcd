"""Whitening of embeddings by a compensated covariance.

Each entry c becomes x = floor(256 * c); the fit list is every different x vector
once.  Its size n and sums S are exact whole numbers.  Centred vectors x - S / n are
held as sums of two doubles; a block of them is cut into slices of few bits, so
that the products of two slices, summed over the block by a matrix product, are
exact (an error-free transformation), and these sums are added up in
double-double.  Tasks give the high and low parts of each row of the matrix, which
are merged by error-free additions in two rounds.  The driver holds one matrix of
dimension by dimension and solves it by LAPACK's ``syevd``: reduction to
tridiagonal form and divide and conquer.

Defined results: rows whose vector is null or has null, NaN or infinite entries are
dropped; so are rows whose vector has another length than most of the rest have (of
equally frequent lengths the smaller counts), and empty vectors; entries beyond the range of long
saturate; rows may repeat, also with equal ids or null ids, and each is returned; components without
variance (eigenvalue at most dimension * 2**-52 of the largest) are left out, so a
table with one different vector, or an empty one, gives no rows; deviation is null
where it does not fit a long; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .groups import Group, map_groups

COMPONENTS, SCALE = 4, 256
#: BLOCK * 2 ** (2 * BITS) must be at most 2 ** 53 for exact block sums.
BLOCK, BITS, SLICES = 4096, 20, 5
#: Tasks are merged in so many groups first.
FAN = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, tail: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of (high, low) and (more, tail)."""
    s, e = two_sum(high, more)
    e = e + (low + tail)
    total = s + e
    return total, e - (total - s)


def parts(x: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    """Fractions as the nearest double and the nearest double of the rest."""
    high = [float(v) for v in x]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(x, high, strict=True)])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as high and low parts; x are whole numbers."""
    high, low = x.astype(np.float64), np.zeros(x.shape)
    for at in zip(*np.nonzero((x >= 1 << 53) | (x <= -(1 << 53))), strict=True):  # whole numbers that a double rounds
        low[at] = float(int(x[at]) - int(high[at]))
    return added(high, low, -mean[0], -mean[1])


def sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices whose sum is high + low but for 2 ** -(BITS * SLICES) of the largest entry of a column; products of two add up exactly."""
    top = np.abs(high).max(axis=0, initial=0.0)
    unit, out = 2.0 ** (np.ceil(np.log2(np.where(top > 0, top, 1.0))) - BITS + 1), []
    for _ in range(SLICES):
        q = np.rint(high / unit) * unit
        out.append(q)
        high, low = two_sum(high - q, low)
        unit = unit * 2.0**-BITS
    return out


def products(high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """Exact matrices whose sum is the sum of outer products of the rows."""
    cut = sliced(high, low)
    for i in range(len(cut)):
        for j in range(i, len(cut) - i):
            p = cut[i].T @ cut[j]
            yield p
            if i != j:
                yield p.T


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that remain, and the length of x."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = df.where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    lengths = good.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = lengths[0].width if lengths else 1
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return good.where(F.size(v) == width).select(F.col(id_col).alias("vec_id"), x.alias("x")), width


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums; only a row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, low = 0, np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            n, top, low = n + len(x), top + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(top), pa.array(low)], names=["dim", "n", "top", "low"])

    wide = "decimal(38,0)"
    found = fit.select("x").mapInArrow(run, "dim int, n long, top long, low long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("top").cast(wide)).alias("top"), F.sum(F.col("low").cast(wide)).alias("low")).collect()
    out = [0] * width
    for r in found:
        out[r.dim] = (int(r.top) << 32) + int(r.low)
    return (int(found[0].n) if found else 0), out


HALVES = "part int, dim int, high array<double>, low array<double>"


def _rows(part: int, high: np.ndarray, low: np.ndarray, dims: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(dims), pa.int32()), pa.array(dims, pa.int32()), pa.array(list(high), pa.list_(pa.float64())), pa.array(list(low), pa.list_(pa.float64()))], names=["part", "dim", "high", "low"])


def covariance(fit: DataFrame, width: int, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """High and low parts of the sum of centred outer products over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high, low = np.zeros((width, width)), np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                for p in products(*centred(x[at : at + BLOCK], mean)):
                    high, low = added(high, low, p)
        yield _rows(TaskContext.get().partitionId() % FAN, high, low, list(range(width)))

    def merge(group: Group) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width), np.zeros(width)
        for h, e in zip(group["high"], group["low"], strict=True):
            high, low = added(high, low, np.array(h), np.array(e))
        yield _rows(0, [high], [low], [int(group["dim"][0])])

    each = fit.select("x").mapInArrow(run, HALVES)
    once = map_groups(each, ["part", "dim"], merge, HALVES)
    high, low = np.zeros((width, width)), np.zeros((width, width))
    for r in map_groups(once, ["part", "dim"], merge, HALVES).collect():  # ``once`` has part 0 throughout: a row for each dimension
        high[r.dim], low[r.dim] = r.high, r.low
    return high, low


def solved(high: np.ndarray, low: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, their vectors as columns, and the trace, of the covariance."""
    v = high / n + low / n
    v = (v + v.T) / 2
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(components, int((e > len(e) * 2.0**-52 * max(e[0], 0)).sum()))
    return e[:keep], u[:, :keep], float(np.trace(v))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    spark = df.sparkSession
    rows, width = whole_vectors(df, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = store(rows.select("x").distinct(), "fit")
    n, total = sums(fit, width)
    if not n:
        return spark.createDataFrame([], schema)
    mean = parts([Fraction(s, n) for s in total])
    e, u, trace = solved(*covariance(fit, width, n, mean), n, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    k = len(e)
    axes = u / np.sqrt(e)

    def project(x: np.ndarray) -> np.ndarray:
        high, low = centred(x, mean)
        return high @ axes + low @ axes

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = project(matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    white = fit.select("x").mapInArrow(of_fit, ", ".join(f"w{i} double" for i in range(k)))
    middle = white.agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.avg((F.col(f"w{i}") - middle[i]) * (F.col(f"w{j}") - middle[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))

    def deviations(x: np.ndarray) -> list:
        far = max((n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, total))), 1)
        kind = np.int64 if width * far * far < 1 << 63 else object
        d = ((x.astype(kind) * n - np.array(total, dtype=kind)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in d.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            w, at = project(x), np.repeat(np.arange(len(x)), k)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), pa.array(deviations(x), pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(e / trace, len(x))), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
