"""64-bit hashes of the words of many texts at once, from their UTF-8 bytes.

A word's hash is a polynomial over its bytes (each byte value stands for a
fixed random number), so all words of a stretch of text come from one running
sum.  Equal words have equal hashes; different words collide with a chance of
about 2 ** -60 a pair, and callers compare real words before they decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes handled at once; a longer word makes the stretch longer.
STRETCH = 1 << 18
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def byte_values() -> np.ndarray:
    """The number of each byte; A-Z have those of a-z, white space has none."""
    values = np.random.Generator(np.random.PCG64(417)).integers(1, MASK, 256, np.uint64, endpoint=True)
    values[65:91] = values[97:123]
    values[list(SPACE)] = 0
    return values


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2 ** 64; one table, made longer when needed."""
    if not _POWERS or len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            size = 1 << max(n, STRETCH).bit_length()
            up = np.full(size, BASE, np.uint64)
            down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _stretches(data: np.ndarray, offsets: np.ndarray, white: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends are at white space or between texts."""
    a = 0
    while a < len(data):
        b = a + STRETCH
        if b >= len(data):
            b = len(data)
        else:
            text_end = int(offsets[np.searchsorted(offsets, b)])
            space = np.flatnonzero(white[data[b:text_end]][: STRETCH])
            while not len(space) and b + STRETCH < text_end:
                b += STRETCH
                space = np.flatnonzero(white[data[b:text_end]][: STRETCH])
            b = b + int(space[0]) if len(space) else text_end
        yield a, b
        a = b


def inside_words(data: np.ndarray) -> np.ndarray:
    """Which bytes are no white space; comparing bytes is much faster than looking them up."""
    return (data != 32) & (data - np.uint8(9) > 4)  # numbers of 8 bits: what is below 9 wraps


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte) of every word of a string column, with its bytes and offsets.  A-Z count as a-z."""
    data, offsets = text_bytes(column)
    values, white = byte_values(), np.zeros(256, bool)
    white[list(SPACE)] = True
    firsts = np.zeros(len(data) + 1, bool)
    firsts[offsets] = True
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    with np.errstate(over="ignore"):
        for a, b in _stretches(data, offsets, white):
            part = data[a:b]
            inside = inside_words(part)
            before = np.concatenate(([False], inside[:-1])) & ~firsts[a:b]
            after = np.concatenate((inside[1:], [False])) & ~firsts[a + 1 : b + 1]
            s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
            if not len(s):
                continue
            up, down = powers(b - a)
            total = values.take(part, mode="clip")
            total *= up[: b - a]
            total = np.cumsum(total, out=total)
            low = np.where(s > 0, total[s - 1], np.uint64(0))
            hashes.append(mix((total[e] - low) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + a)
    return np.concatenate(hashes), np.concatenate(starts), data, offsets
