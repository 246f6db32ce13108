"""Words, n-grams and rolling fingerprints of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

CHUNK_BYTES = 1 << 18  # a worker holds up to about 120 bytes for each of them, in arrays that stay in the cache
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15  # fixed odd multiplier of the fingerprints


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@cache
def byte_values(fold_case: bool) -> np.ndarray:
    """A random number for each byte; with ``fold_case`` A-Z count as a-z."""
    values = mixed(np.arange(1, 257, dtype=_U) * _U(_ODD))
    if fold_case:
        values[65:91] = values[97:123]
    return values


@cache
def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    return white


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=_U))
        del _powers[:-2]
    return _powers[0][:n], _powers[1][:n]


def chunked(texts: Iterable[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of about ``size`` bytes each; a longer text is a chunk of its own. Null is empty."""
    first, held, total = 0, [], 0
    for row, text in enumerate(texts):
        text = text or b""
        if held and total + len(text) > size:
            yield first, held
            first, held, total = row, [], 0
        held.append(text)
        total += len(text) + 1
    if held:
        yield first, held


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: 64-bit fingerprints (A-Z as a-z) in order, and where each text's start."""

    def __init__(self, texts: list[bytes], fold_case: bool = True):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = ~_white()[joined]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        forward, back = powers(len(joined) + 1)
        total = np.zeros(len(joined) + 1, _U)
        np.cumsum(byte_values(fold_case)[joined] * forward[:-1], dtype=_U, out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * back[self.start])
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.text_start = begins
        self.first = np.searchsorted(self.start, begins)  # of text i: words first[i] to first[i + 1]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all n-word runs, and the first of each text: text i has grams first[i] to first[i + 1].

        A text of fewer words has one run of all of them, one without words none.
        """
        h, first = self.hash, self.first
        count = np.diff(first)
        size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        out = np.empty(at[-1], _U)
        full = np.zeros(max(len(h) - n + 1, 0), _U)
        for j in range(n):
            full = full * _U(_ODD) + h[j:j + len(full)]
        full = mixed(full + _U(n))
        for i in np.flatnonzero(size):
            if count[i] >= n:
                out[at[i]:at[i + 1]] = full[first[i]:first[i] + size[i]]
            else:
                value = 0
                for x in h[first[i]:first[i + 1]].tolist():
                    value = (value * _ODD + x) & ((1 << 64) - 1)
                out[at[i]] = mixed(np.array([value + int(count[i])], _U))[0]
        return out, at


def digest128(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of a set of numbers, in any order."""
    a = int(mixed(values).sum(dtype=_U)) if len(values) else 0
    b = int(mixed(values ^ _U(0x5DEECE66D1234567)).sum(dtype=_U)) if len(values) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))
