"""Word and shingle hashing over Arrow string buffers, vectorised with numpy.

Words are hashed from the UTF-8 bytes after lower-casing A-Z; shingles combine
the hashes of consecutive words. All work is done on pieces of bounded size, so
that the memory used does not depend on the length of a text or of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Bytes hashed at a time, and bytes of text handled at a time.
_SEGMENT = 1 << 18
_PIECE = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POW = _powers(_BASE, _SEGMENT)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers (the public splitmix64 step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _long_word(b: np.ndarray) -> int:
    """A word longer than a segment: the hashes of its segments, folded."""
    h = 0
    for i in range(0, len(b), _SEGMENT):
        part = b[i : i + _SEGMENT]
        with np.errstate(over="ignore"):
            s = int(((part.astype(np.uint64) + np.uint64(1)) * _POW[: len(part)]).sum(dtype=np.uint64))
        h = (h * 0xD6E8FEB86659FD93 + s + 1) % (1 << 64)
    return h


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + _SEGMENT, "right"))
        if j <= i:
            out[i] = _long_word(b[at : int(ends[i])])
            i += 1
            continue
        part = b[at : int(ends[j - 1])]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POW[: len(part)], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[e] - total[s]) * _INV[s]
        i = j
    lengths = (ends - starts).astype(np.uint64)
    return mix(out ^ (lengths * np.uint64(0xA0761D6478BD642F)))


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about _PIECE bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(column: pa.Array, lower: bool | bytes = True, marks: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, word starts, word ends, first word of each row and the count of words).

    Bytes are lower-cased in A-Z, or where ``lower`` is a string, in runs of rows without it.
    With ``marks``, a full stop or comma behind an ASCII letter or digit begins a word too.
    """
    for first, raw, offsets in _pieces(column):
        b = _LOWER[raw] if (lower if isinstance(lower, bool) else lower not in raw.tobytes()) else raw
        ink = ~_SPACE[raw]
        before = np.empty(len(ink), bool)
        after = np.empty(len(ink), bool)
        if len(ink):
            before[0] = after[-1] = False
            before[1:] = ink[:-1]
            after[:-1] = ink[1:]
            inner = offsets[(offsets > 0) & (offsets < len(ink))]
            if marks:
                inner = np.concatenate([inner, np.flatnonzero(_STOP[raw[1:]] & _PLAIN[raw[:-1]]) + 1])
            before[inner] = False
            after[inner - 1] = False
        starts = np.flatnonzero(ink & ~before)
        ends = np.flatnonzero(ink & ~after) + 1
        yield first, b, starts, ends, np.searchsorted(starts, offsets)


def shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its shingles with repeats) for every row; short texts give one or none."""
    # unrelated odd factors, so that no rearrangement of the same words sums to the same value
    odd = mix(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)
    for first, b, starts, ends, at in words(column):
        h = word_hashes(b, starts, ends)
        if len(h) >= n:
            m = len(h) - n + 1
            g = h[:m] * odd[0]
            for k in range(1, n):
                g += h[k : k + m] * odd[k]
            g = mix(g)
        for row in range(len(at) - 1):
            s, e = int(at[row]), int(at[row + 1])
            if e - s >= n:
                yield first + row, g[s : e - n + 1]
            elif e > s:
                x = np.array([e - s], np.uint64)
                for k in range(s, e):
                    x = mix(x ^ (h[k : k + 1] * odd[k - s]))
                yield first + row, x
            else:
                yield first + row, np.empty(0, np.uint64)
