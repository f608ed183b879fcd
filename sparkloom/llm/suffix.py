"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Leftmost-smaller (LMS) substrings are sorted by one induction and named; the
string of names is sorted recursively, and its order induces that of all suffixes.

An induction of a few letters goes bucket by bucket.  What a bucket holds when the
scan reaches it is one wave; suffixes that the wave puts into the same bucket are
the next one.  All steps of a wave are array operations, so the loop runs over
letters, not suffixes.  With more than ``LARGE`` letters (in the recursion, where
buckets hold few suffixes) the same induction goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

LARGE = 2048


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last letter is a unique smallest one."""
    n = len(s)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _put(sa: np.ndarray, items: np.ndarray, letters: np.ndarray, edge: np.ndarray, up: bool) -> None:
    """Append items, in order, to their letters' buckets; up: from the left, else from the right."""
    order = np.argsort(letters, kind="stable")
    sorted_letters = letters[order]
    first = np.concatenate(([0], np.flatnonzero(sorted_letters[1:] != sorted_letters[:-1]) + 1)) if len(items) else np.zeros(0, np.int64)
    found, counts = sorted_letters[first], np.diff(np.append(first, len(items)))
    rank = np.arange(len(items)) - np.repeat(first, counts)
    if up:
        sa[np.repeat(edge[found], counts) + rank] = items[order]
        edge[found] += counts
    else:
        sa[np.repeat(edge[found], counts) - 1 - rank] = items[order]
        edge[found] -= counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes in the order that the given order of LMS suffixes induces."""
    n = len(s)
    sa = np.full(n, -1, dtype=np.int64)
    tail = ends.copy()
    _put(sa, lms[::-1], s[lms[::-1]], tail, False)
    head = starts.copy()
    letters = np.flatnonzero(ends > starts)

    def larger(c: int, wave: np.ndarray) -> np.ndarray:
        before = wave[wave > 0] - 1
        before = before[~smaller[before]]
        t = s[before]
        same = before[t == c]
        other = t != c
        if other.any():
            _put(sa, before[other], t[other], head, True)
        return same

    for c in letters:
        done = starts[c]
        while done < head[c]:
            wave = sa[done : head[c]].copy()
            done = head[c]
            same = larger(c, wave)
            sa[head[c] : head[c] + len(same)] = same
            head[c] += len(same)
        right = sa[tail[c] : ends[c]]
        if len(right):
            larger(c, right.copy())
    tail = ends.copy()

    def less(c: int, wave: np.ndarray) -> np.ndarray:
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        t = s[before]
        same = before[t == c]
        other = t != c
        if other.any():
            _put(sa, before[other], t[other], tail, False)
        return same

    sa[0] = n - 1
    for c in letters[::-1]:
        done = ends[c]
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            same = less(c, wave)
            sa[tail[c] - len(same) : tail[c]] = same[::-1]
            tail[c] -= len(same)
        left = sa[starts[c] : head[c]]
        if len(left):
            less(c, left[::-1].copy())
    return sa


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of the sorted LMS substrings; equal ones have equal names."""
    n = len(s)
    end = np.full(n, n - 1, dtype=np.int64)
    end[lms[:-1]] = lms[1:]
    size = end[order] - order + 1
    size[order == n - 1] = 0
    differs = np.ones(len(order), dtype=bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    a, b, left = order[same], order[same - 1], size[same].copy()
    k = 0
    equal = np.zeros(len(order), dtype=bool)
    while len(same):
        keep = s[np.minimum(a + k, n - 1)] == s[np.minimum(b + k, n - 1)]
        k += 1
        finished = keep & (left <= k)
        equal[same[finished]] = True
        keep &= ~finished
        same, a, b, left = same[keep], a[keep], b[keep], left[keep]
    differs[equal] = False
    name = np.cumsum(differs) - 1
    by_place = np.zeros(n, dtype=np.int64)
    by_place[order] = name
    return by_place[lms], int(name[-1]) + 1


def _induce_each(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``_induce``, suffix by suffix; both scans read the places that they fill.

    For a place, ``larger`` and ``less`` have the letter before it where the suffix
    from there is of that type, else -1; their last entry answers for empty places.
    """
    larger, less = np.full((2, len(s) + 1), -1, dtype=np.int64)
    larger[1:-1] = np.where(smaller[:-1], -1, s[:-1])
    less[1:-1] = np.where(smaller[:-1], s[:-1], -1)
    first = np.full(len(s), -1, dtype=np.int64)
    _put(first, lms[::-1], s[lms[::-1]], ends.copy(), False)
    sa, before, edge = first.tolist(), larger.tolist(), starts.tolist()
    for place in sa:
        c = before[place]
        if c >= 0:
            to = edge[c]
            sa[to] = place - 1
            edge[c] = to + 1
    before, edge = less.tolist(), ends.tolist()
    for place in reversed(sa):
        c = before[place]
        if c >= 0:
            edge[c] = to = edge[c] - 1
            sa[to] = place - 1
    return np.array(sa, dtype=np.int64)


def _sort(s: np.ndarray, letters: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    induce = _induce_each if letters > LARGE else _induce
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=letters))
    starts = np.concatenate(([0], ends[:-1]))
    first = induce(s, smaller, lms, starts, ends)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names, count = _names(s, order, lms)
    if count < len(lms):
        order = lms[_sort(names, count)]
    return induce(s, smaller, order, starts, ends)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of an array of numbers from 0 on, in order."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    if text.dtype.itemsize <= 2:
        used = np.bincount(text, minlength=int(text.max()) + 1) > 0
        letters, dense = int(used.sum()), (np.cumsum(used) - 1)[text]
    else:
        found, dense = np.unique(text, return_inverse=True)
        letters = len(found)
    return _sort(np.append(dense.astype(np.int64) + 1, 0), letters + 1)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the suffix before it in the suffix array.

    Only places whose left neighbours differ are compared letter by letter; at
    any other place the value is one less than at the place before it.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    free = (phi <= 0) | (place == 0)
    free[1:] |= text[:-1] != text[np.maximum(phi[1:] - 1, 0)]
    value = np.zeros(n, dtype=np.int64)
    i = np.flatnonzero(free & (phi >= 0))
    j = phi[i]
    pad = np.append(text.astype(np.int64), -1)
    k = 0
    while len(i):
        same = (pad[np.minimum(i + k, n)] == pad[np.minimum(j + k, n)]) & (np.maximum(i, j) + k < n)
        value[i[~same]] = k
        i, j = i[same], j[same]
        k += 1
    last = np.maximum.accumulate(np.where(free, place, 0))
    return np.maximum(value[last] - (place - last), 0) * (phi >= 0)
