"""Vectorised word and shingle hashes over the bytes of an Arrow string column.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the same as a run of such characters.
Hashes have 64 bits: a polynomial over the bytes, finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
WORD_BASE = 0xD1342543DE82EF95
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table only grows."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, U(base), dtype=U)
        have[0] = U(1)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and len+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about limit bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word's number of each text (len+1)."""
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = False
    edge[1:] = inside
    first = inside & ~edge[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = np.zeros(len(data), dtype=bool)
    if len(data):
        last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
        last[-1] = inside[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    x = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix(x + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the first word's number of each text."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), starts, ends, first


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words, len(words)-n+1 of them; runs may cross texts."""
    if len(words) < n:
        return np.zeros(0, dtype=U)
    if n <= 8:
        out = np.zeros(len(words) - n + 1, dtype=U)
        for j, c in enumerate(powers(WORD_BASE, n + 1)[1:].tolist()):
            out += words[j : len(words) - n + 1 + j] * U(c)
        return mix(out)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * powers(WORD_BASE, len(words)), out=total[1:])
    inverse = powers(pow(WORD_BASE, -1, 1 << 64), len(words))
    return mix((total[n:] - total[:-n]) * inverse[: len(words) - n + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
