"""Vectorised work on batches of texts: Arrow buffers in, numpy arrays out, no Python object for a word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
#: Odd multipliers of two independent polynomial hashes over bytes, with their inverses modulo 2**64, and one over words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
OVER_WORDS = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that are hashed at once.
BLOCK = 1 << 17


def release() -> None:
    """Give freed memory back to the system: a worker lives on for other tasks, and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. offsets[0] is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about `most` bytes of text, a single longer text being a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        _, o = text_buffers(b.column(column))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
        release()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one more): words are runs of anything but ASCII white space."""
    inside = ~WHITE[data]
    head, last = inside.copy(), inside.copy()
    if len(data):
        head[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        at = cut[(cut > 0) & (cut < len(data))]
        head[at] |= inside[at]
        last[at - 1] |= inside[at - 1]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(max(n, 2 * BLOCK), b, U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = (tables[0], tables[1])
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of ordered, disjoint byte spans; which chooses one of two independent functions."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        n = int(e[-1])
        up, down = _power(BASES[which], n + 1)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum((data[lo : lo + n].astype(U) + U(1)) * up[:n], out=sums[1:])
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(OVER_WORDS))
        at = to
    return out


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words from each place, whether they all belong to one text); places near the end are False."""
    total = len(words)
    h = np.zeros(total, U)
    factor = 1
    for k in range(min(n, total)):
        h[: total - k] += words[k:] * U(factor)
        factor = factor * OVER_WORDS % (1 << 64)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return mix(h + U(n)), room >= n


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[i] ... starts[i] + lengths[i] - 1 for each i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def binary_rows(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are data[:ends[0]], data[ends[0]:ends[1]] and so on."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
