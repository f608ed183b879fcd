"""Word shingles as sorted 128-bit names, computed without a loop over words."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xC2B2AE3D27D4EB4F)
NAME = np.dtype([("a", "<u8"), ("b", "<u8")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_names(raw: bytes) -> np.ndarray:
    """A 128-bit hash of each word [^\\x20\\x09-\\x0D]+ of a text, A-Z lowered, in text order."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.lower().split())), dtype=NAME)


def unique(names: np.ndarray, counts: bool = False):
    """Different names, sorted (with ``counts``: and how often each occurs)."""
    order = np.argsort(names["a"], kind="stable")
    s = names[order]
    new = np.ones(len(s), dtype=bool)
    same = s["a"][1:] == s["a"][:-1]
    if (same & (s["b"][1:] != s["b"][:-1])).any():  # names that agree in one half only
        s = names[np.lexsort((names["b"], names["a"]))]
        same = s["a"][1:] == s["a"][:-1]
    new[1:] = ~same | (s["b"][1:] != s["b"][:-1])
    if not counts:
        return s[new]
    return s[new], np.diff(np.append(np.flatnonzero(new), len(s)))


def places(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each name the number of its value among all different ones, and how often each value occurs."""
    order = np.lexsort((names["b"], names["a"]))
    s = names[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out, np.diff(np.append(np.flatnonzero(new), len(s)))


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The set of ``words``-word shingles, sorted; with fewer words the whole sequence is one, without words none."""
    w = word_names(raw)
    if not len(w):
        return w
    n = min(words, len(w))
    out = np.empty(len(w) - n + 1, dtype=NAME)
    for lane, c in (("a", _C), ("b", _D)):
        h = np.full(len(out), np.uint64(n), dtype=np.uint64)
        for k in range(n):
            h = mix(h * c + w[lane][k : k + len(out)])
        out[lane] = h
    return unique(out)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    return len(a) + len(b) - len(unique(np.concatenate((a, b))))
