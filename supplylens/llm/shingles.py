"""Words and shingles of many texts at once, in numpy (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a piece of its own.
CHUNK = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with ``most`` bytes or a single row.  Null is empty."""
    binary = texts.cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    n = len(binary)
    _, ends, data = binary.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[binary.offset:binary.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, data[ends[a]:ends[b]], ends[a:b + 1] - ends[a]
        a = b


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end: each word's hash, text number, first byte and byte after it.

    A-Z counts as a-z.  Words are runs of bytes other than blank and 9 to 13.
    """
    low = _LOWER[data]
    solid = ~_SPACE[low]
    first = np.zeros(len(low) + 1, dtype=bool)
    first[ends] = True
    before = np.concatenate(([False], solid))[:-1]
    begins = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate((solid, [False]))[1:]
    stops = np.flatnonzero(solid & (~after | first[1:])) + 1
    power, inverse = _power(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    hashes = mix((total[stops] - total[begins]) * inverse[begins] + np.uint64(0x632BE59BD9B4E019))
    return hashes, np.searchsorted(ends, begins, "right") - 1, begins, stops


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes."""
    out = hashes[:len(hashes) - width + 1].copy()
    for i in range(1, width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i:len(hashes) - width + 1 + i])
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes.

    With fewer than ``width`` words the whole sequence is one shingle;
    without words there is none.
    """
    for a, b, data, ends in chunks(texts):
        hashes, owner, _, _ = words(data, ends)
        limits = np.searchsorted(owner, np.arange(b - a + 1))
        runs = fold(hashes, width) if len(hashes) >= width else hashes[:0]
        for i, j in zip(limits[:-1].tolist(), limits[1:].tolist()):
            if j - i >= width:
                yield np.unique(runs[i:j - width + 1])
            elif j > i:
                yield mix(fold(hashes[i:j], j - i) + np.uint64(j - i))
            else:
                yield hashes[:0]
