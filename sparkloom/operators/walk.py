"""The sequential walk of Louvain over one component, in the order of its nodes.

Nodes are numbers from 0. A task holds a few numbers a node and a block of edges; the edges
themselves are read anew, in the order of their nodes, by each pass.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

# Bounds of the method; edges that are read at a time; neighbours up to which a plain loop is faster.
PASSES, LEVELS, LEAST_GAIN = 25, 6, 1e-12
BLOCK, FEW = 65_536, 24
EDGE = np.dtype([("to", "<i8"), ("weight", "<f8")])


class Near:
    """The edges of nodes, in both directions and in the order of nodes; more than ``kept`` of them are in a file of the task."""

    def __init__(self, n: int, kept: int):
        at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.kept, self.count = kept, np.zeros(n, np.int64)
        self.file = tempfile.SpooledTemporaryFile(max_size=kept * EDGE.itemsize, dir=at if os.path.isdir(at) else None)

    def add(self, of: np.ndarray, to: np.ndarray, weight: np.ndarray) -> None:
        rows = np.empty(len(of), EDGE)
        rows["to"], rows["weight"] = to, weight
        self.file.write(rows.tobytes())
        nodes, n = np.unique(of, return_counts=True)
        self.count[nodes] += n

    def close(self) -> None:
        self.file.close()

    def blocks(self, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray]]:
        """(nodes, where their edges begin and end, to, weight) of all nodes in ``order``, so many that they have ``BLOCK`` edges, or one that has more."""
        start = np.cumsum(self.count) - self.count
        order = np.arange(len(self.count)) if order is None else order
        end = np.cumsum(self.count[order])
        k = 0
        while k < len(order):
            done = end[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(end, done + BLOCK, "right")))
            nodes = order[k:stop]
            parts = []
            for run in np.split(nodes, np.flatnonzero(np.diff(nodes) != 1) + 1):  # what lies together is read together
                self.file.seek(int(start[run[0]]) * EDGE.itemsize)
                parts.append(self.file.read(int(self.count[run].sum()) * EDGE.itemsize))
            rows = np.frombuffer(b"".join(parts), EDGE)
            yield nodes, [0, *(end[k:stop] - done).tolist()], np.ascontiguousarray(rows["to"]), np.ascontiguousarray(rows["weight"])
            k = stop


def one_level(near: Near, gamma: float, total: float) -> np.ndarray | None:
    """The community of each node after moves in the order of nodes; None if none moved."""
    n = len(near.count)
    of, degree = np.arange(n), np.zeros(n)
    for nodes, at, _, w in near.blocks():
        degree[nodes] = [sum(w[a:b].tolist()) for a, b in zip(at, at[1:])]
    weight = degree.copy()
    ever = False
    for _ in range(PASSES):
        moved = False
        for nodes, at, to, w in near.blocks():
            for u, a, b in zip(nodes.tolist(), at, at[1:]):
                mine, k = int(of[u]), float(degree[u])
                weight[mine] -= k
                best = (_best_of_few if b - a <= FEW else _best)(u, mine, to[a:b], w[a:b], gamma * k / total, of, weight)
                weight[best] += k
                if best != mine:
                    of[u], moved, ever = best, True, True
        if not moved:
            break
    return of if ever else None


def _best_of_few(u: int, mine: int, to: np.ndarray, w: np.ndarray, share: float, of: np.ndarray, weight: np.ndarray) -> int:
    links: dict[int, float] = {}
    for v, c, x in zip(to.tolist(), of[to].tolist(), w.tolist()):
        if v != u:
            links[c] = links.get(c, 0.0) + x
    best, gain = mine, links.get(mine, 0.0) - share * float(weight[mine])
    for c in sorted(links):
        new = links[c] - share * float(weight[c])
        if new > gain + LEAST_GAIN:
            best, gain = c, new
    return best


def _best(u: int, mine: int, to: np.ndarray, w: np.ndarray, share: float, of: np.ndarray, weight: np.ndarray) -> int:
    """As ``_best_of_few``, sums in the same order."""
    other = to != u
    if not other.all():
        to, w = to[other], w[other]
    found, which = np.unique(of[to], return_inverse=True)
    new = np.bincount(which, w, len(found)) - share * weight[found]
    k = int(np.searchsorted(found, mine))
    best, gain = mine, float(new[k]) if k < len(found) and found[k] == mine else 0.0 - share * float(weight[mine])
    above = np.flatnonzero(new > gain + LEAST_GAIN)
    if len(above):
        new, found = new[above], found[above]
        most = np.maximum.accumulate(new)
        for k in [0, *(np.flatnonzero(new[1:] > most[:-1]) + 1).tolist()]:  # one that is taken exceeds all before it
            if new[k] > gain + LEAST_GAIN:
                best, gain = int(found[k]), float(new[k])
    return best


def folded(near: Near, of: np.ndarray, n: int) -> Near:
    """The graph of the communities ``of`` the nodes; the edges within one are its loop."""
    out = Near(n, near.kept)
    keys, sums = np.zeros(0, np.int64), np.zeros(0)
    for nodes, at, to, w in near.blocks(np.argsort(of, kind="stable")):
        keys = np.concatenate([keys, np.repeat(of[nodes], np.diff(at)) * n + of[to]])
        keys, which = np.unique(keys, return_inverse=True)
        sums = np.bincount(which, np.concatenate([sums, w]), len(keys))
        if len(keys):  # the last community may go on in the next block
            k = int(np.searchsorted(keys, keys[-1] // n * n))
            out.add(keys[:k] // n, keys[:k] % n, sums[:k])
            keys, sums = keys[k:], sums[k:]
    out.add(keys // n, keys % n, sums)
    return out


def solve(near: Near, gamma: float, total: float, levels: int = LEVELS) -> np.ndarray:
    """For each node the smallest node of its community, levels included. Closes ``near``."""
    whole = np.arange(len(near.count))
    for _ in range(levels):
        of = one_level(near, gamma, total)
        if of is None:
            break
        names, of = np.unique(of, return_inverse=True)
        whole = of[whole]
        fewer = folded(near, of, len(names))
        near.close()
        near = fewer
    near.close()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    return first[which]
