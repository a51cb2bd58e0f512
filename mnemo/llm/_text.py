"""Byte-level helpers: whole Arrow string columns as numpy arrays, in pieces of bounded size.

Every hash here is a 64-bit polynomial over bytes (or over word hashes), finished by a mixer, so the
hash of a word or window does not depend on where it stands or how a column was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
PIECE_BYTES = 1 << 18

#: ASCII letters to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes of words parted by space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[32, *range(9, 14)]] = False

#: True for ASCII digits, lower-case letters and every byte above 0x7F.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose ``name`` column holds about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes in ``table``; runs never cross rows."""
    is_word = table[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = PIECE_BYTES) -> np.ndarray:
    """A 64-bit hash of each span, computed over blocks of about ``block`` bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        size = ends[at:to] - starts[at:to]
        cuts = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size)
        chosen = data[lo:hi][inside + np.repeat(starts[at:to] - lo, size)].astype(np.uint64) + np.uint64(1)
        chosen *= powers(BASE, int(size.max()))[inside]
        out[at:to] = np.add.reduceat(chosen, cuts[:-1])
        at = to
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes (rows are not considered)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    p = powers(WORD_BASE, n)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * p[i]
    return mix(out)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column whose rows take ``counts`` values each, in order."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
