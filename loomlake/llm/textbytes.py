"""Texts as numpy byte arrays: prefix polynomial hashes, words, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at a time; one longer text stands alone.
CHUNK = 2 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((BASE, _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class PrefixHash:
    """Hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        ahead, self.back = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Not mixed: equal for equal substrings of equal length."""
        return (self.sums[end] - self.sums[start]) * self.back[start]


def joined(texts: list[bytes], gap: bytes = b"\x00") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with ``gap`` after each, and where each begins; one more for the end."""
    data = np.frombuffer(gap.join(texts) + gap, np.uint8) if texts else np.zeros(0, np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=at[1:])
    return data, at


def chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8 (null: empty), in lists of about CHUNK bytes."""
    some, size = [], 0
    for x in column.cast(pa.large_binary()):
        b = x.as_py() or b""
        if some and size + len(b) > CHUNK:
            yield some
            some, size = [], 0
        some.append(b)
        size += len(b)
    if some:
        yield some


def table(classes: str) -> np.ndarray:
    """Truth of each byte value: is it matched by this regular expression class of bytes?"""
    import re

    pattern = re.compile(classes.encode("latin-1"))
    return np.array([bool(pattern.match(bytes([i]))) for i in range(256)])


LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = is_word[data]
    step = np.diff(mask)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
