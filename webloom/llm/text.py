"""Vectorised views of text columns: words, lines and hashes over Arrow's own UTF-8 buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes that one vectorised step works on at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """0x100000001B3 to the powers 0 to n-1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), 0x100000001B3, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            grown = np.multiply.accumulate(grown)
        if len(grown) > 1 << 22:
            return grown
        _POWERS = grown
    return _POWERS[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string column of about `step` bytes each."""
    ends = offsets(column)[1:] if len(column) else np.zeros(0, np.int64)
    a, base = 0, int(offsets(column)[0]) if len(column) else 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, base + step, "right")))
        yield a, b
        a, base = b, int(ends[b - 1])


def strings(column) -> pa.Array:
    """A column of texts as one Arrow string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.fill_null("") if column.null_count else column


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = offsets(column)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in `inside`; a run ends where a text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[at] = True
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~cut[:-1]
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~cut[1:]
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside \\x20 and \\x09-\\x0D."""
    return runs(~_SPACE[data], at)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (none empty, in order, not overlapping)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    inner = place - np.repeat(heads, lengths)
    with np.errstate(over="ignore"):
        terms = (data[inner + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inner]
        return mixed(np.add.reduceat(terms, heads) + lengths.astype(np.uint64) * MULTIPLIER)


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each range belongs to."""
    return np.searchsorted(at, starts, "right") - 1


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * MULTIPLIER + h[j : len(h) - n + 1 + j]
        return mixed(out)
