"""Hashes of the words of many texts at once, without a Python object for any word.

A word's hash is a polynomial in its code points modulo 2**64, taken as the difference of two prefix sums and mixed
once more; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

from .common import KEPT

_P = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _forget() -> None:
    _TABLES.clear()
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


KEPT["words"] = _forget


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Which code points are parts of words, and a number for each."""
    if kind not in _TABLES:
        points = np.arange(0x110000, dtype=np.uint64)
        if kind == "letters":  # runs of letters, digits and underscores
            inside = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
            inside[ord("_")] = True
        else:  # "blanks": runs of anything but ASCII white space, A-Z read as a-z
            inside = np.ones(0x110000, bool)
            inside[9:14] = inside[32] = False
            points[65:91] += np.uint64(32)
        _TABLES[kind] = inside, mix(points + np.uint64(_P))
    return _TABLES[kind]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for at, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[at] = np.cumprod(row, dtype=np.uint64)
    return _POWERS


def word_hashes(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, places where each text's words begin and the last text's end)."""
    inside, number = _tables(kind)
    flat = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    at = 0  # where no word is open
    while at < len(flat):
        end = min(len(flat), at + _CHUNK)
        part = inside[flat[at:end]]
        while end < len(flat) and part[-1]:  # to the last place outside of a word, or the first one further on
            gaps = np.flatnonzero(~part[1:])
            if len(gaps):
                end = at + int(gaps[-1]) + 2
                part = part[: end - at]
            else:
                end = min(len(flat), end + len(part))
                part = inside[flat[at:end]]
        power, inverse = _powers(end - at)
        sums = number[flat[at:end]]
        sums *= power[: end - at]
        np.cumsum(sums, out=sums)
        edges = np.flatnonzero(part[1:] != part[:-1])
        first, last = edges[0::2], edges[1::2]
        hashes.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        starts.append(first + (at + 1))
        at = end - 1 if end < len(flat) else end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)
