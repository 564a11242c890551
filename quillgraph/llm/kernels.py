"""Vectorised byte-level text kernels shared by the Arrow-batch operators.

Texts arrive as Arrow string arrays; the kernels look at the UTF-8 buffer
itself and never build one Python object per row. A *word* is a maximal run
of word bytes (see ``LETTERS`` and ``NON_SPACE``) and never crosses a row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 20
_SLICE = 1 << 20

#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
LETTERS = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
#: Word bytes: everything but ASCII blanks and control characters.
NON_SPACE = np.array([i > 32 for i in range(256)])


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix

_BYTE = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _BLOCK + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            tables.append(out)
        _powers = (tables[0], tables[1])
    return _powers


class Words(NamedTuple):
    """Words of a slice of rows: byte spans, 64-bit hashes, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_at: np.ndarray  # len(rows) + 1


def buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string array; a null row is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0]


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives memory that a batch no longer needs back to the system; idle Python workers would hold it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(texts: pa.Array, size: int = _SLICE) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, rows) of about ``size`` bytes each; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, at = buffers(texts)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, texts.slice(row, last - row)
        row = last
    release()


def tokenize(texts: pa.StringArray, word_bytes: np.ndarray = LETTERS) -> Words:
    """Spans and hashes of every word of every row; equal words have equal hashes in any row or batch."""
    raw, at = buffers(texts)
    starts, ends, hashes = [], [], []
    pos, n = 0, len(raw)
    while pos < n:
        stop = min(pos + _BLOCK, n)
        if stop < n:
            row = at[np.searchsorted(at, stop, "right") - 1]
            if row > pos:
                stop = int(row)
            else:
                gaps = np.flatnonzero(~word_bytes[raw[pos:stop]])
                if len(gaps):
                    stop = pos + int(gaps[-1]) + 1
                else:
                    limit = int(at[np.searchsorted(at, pos, "right")])
                    gaps = np.flatnonzero(~word_bytes[raw[stop:limit]])
                    stop = stop + int(gaps[0]) + 1 if len(gaps) else limit
        block = raw[pos:stop]
        inside = word_bytes[block]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        cuts = at[np.searchsorted(at, pos, "right") : np.searchsorted(at, stop, "left")] - pos
        before[cuts], after[cuts - 1] = False, False
        s = np.flatnonzero(inside & ~before)
        e = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power_tables(len(block) + 1)
        total = np.empty(len(block) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[block] * power[: len(block)], out=total[1:])
        hashes.append(_splitmix((total[e] - total[s]) * inverse[s]))
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, value, np.searchsorted(start, at, "left"))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, at its first value; the last n - 1 have none."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + values[k : k + len(out)]
    return _splitmix(out)


def spans_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from each ``begin`` up to ``end``; equal runs have equal hashes wherever they stand."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_splitmix(values) * power[: len(values)], dtype=np.uint64)])
    return _splitmix((total[end] - total[begin]) * inverse[begin])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, at its first value, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; a sort is several times faster than a hash table here."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
