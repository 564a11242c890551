"""Vectors as ``array<float>`` or ``array<double>`` columns, and edit similarity of names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def jaro_winkler_of(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


#: Letters of the longer texts that numpy takes, and cells of a table of letters at a time.
_LONG, _CELLS = 128, 1 << 21


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each, padded with zeros, and their lengths."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(texts), max(1, int(size.max(initial=0)))), np.uint32)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def jaro_winkler_pairs(a: pa.Array, b: pa.Array, scale: float = 0.1) -> np.ndarray:
    """Jaro-Winkler similarity of many pairs of texts at once, letter by letter of the first."""
    x, nx = _letters(a)
    y, ny = _letters(b)
    n = len(x)
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    place = np.arange(y.shape[1])[None, :]
    taken, mine = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        live = np.flatnonzero(nx > i)
        fits = (y[live] == x[live, i, None]) & ~taken[live] & (np.abs(place - i) <= reach[live, None]) & (place < ny[live, None])
        hit = fits.any(axis=1)
        taken[live[hit], fits[hit].argmax(axis=1)] = True
        mine[live, i] = hit
    m = mine.sum(axis=1)
    # Matched letters of both in order, side by side.
    width = int(m.max(initial=0))
    p, q = (np.take_along_axis(t, np.argsort(~f, axis=1, kind="stable")[:, :width], axis=1) for t, f in ((x, mine), (y, taken)))
    swaps = ((p != q) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    with np.errstate(all="ignore"):
        jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    head = min(4, x.shape[1], y.shape[1])
    alike = (x[:, :head] == y[:, :head]) & (np.arange(head)[None, :] < np.minimum(nx, ny)[:, None])
    prefix = np.minimum.accumulate(alike, axis=1).sum(axis=1) if n else m
    same = (nx == ny) & (m == nx) & (swaps == 0) & ((x[:, : min(x.shape[1], y.shape[1])] == y[:, : min(x.shape[1], y.shape[1])]).all(axis=1))
    return np.where(same, 1.0, np.where(m > 0, jaro + prefix * scale * (1 - jaro), 0.0))


def jaro_winkler_table(a: pa.Array, b: pa.Array, scale: float = 0.1) -> np.ndarray:
    """Jaro-Winkler similarity of each of ``a`` to each of ``b``, texts of up to 64 letters, not null.

    Letters of ``b`` are bits of a word: a step takes one letter of each ``a``
    against all letters of each ``b`` at once. What all texts begin with alike
    takes no step.
    """
    (x, nx), (y, ny) = _letters(a), _letters(b)
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    one, zero = np.uint64(1), np.uint64(0)
    known = np.unique(np.concatenate([x.ravel(), y.ravel()]))
    cx, cy = np.searchsorted(known, x), np.searchsorted(known, y)
    # Bits of the places at which a text of b has a letter; none beyond its end.
    at = np.zeros((len(known), len(y)), np.uint64)
    for j in range(y.shape[1]):
        own = np.flatnonzero(ny > j)
        at[cy[own, j], own] |= one << np.uint64(j)
    head, least = 0, int(min(nx.min(), ny.min()))
    while head < least and (x[:, head] == x[0, head]).all() and (y[:, head] == x[0, head]).all():
        head += 1
    start = np.uint64((1 << head) - 1)
    taken, mine = np.full((len(x), len(y)), start), np.full((len(x), len(y)), start)
    reach = np.maximum(0, np.maximum(nx[:, None], ny[None, :]) // 2 - 1)
    even = int(reach[0, 0]) if (reach == reach[0, 0]).all() else None
    near = lambda i, r: np.uint64(sum(1 << j for j in range(max(0, i - r), min(64, i + r + 1))))
    for i in range(head, x.shape[1]):
        live = nx > i
        window = near(i, even) if even is not None else np.array([near(i, r) for r in range(int(reach.max()) + 1)], np.uint64)[reach]
        free = at[cx[:, i]]
        if not live.all():
            free[~live] = zero
        free &= window
        free &= ~taken
        free &= zero - free  # the first of them
        taken |= free
        mine |= (free != 0).astype(np.uint64) << np.uint64(i)
    m = np.bitwise_count(mine).astype(np.float64)
    # The letters matched of either text in order, side by side.
    rest, swaps = taken ^ start, np.zeros(mine.shape, np.int16)
    for i in range(head, x.shape[1]):
        own = (mine >> np.uint64(i)) & one
        low = rest & (zero - rest) & (zero - own)
        swaps += ((at[cx[:, i]] & low) == 0) & (low != 0)
        rest ^= low
    swaps //= 2
    with np.errstate(all="ignore"):
        jaro = np.where(m > 0, (m / nx[:, None] + m / ny[None, :] + (m - swaps) / m) / 3, 0.0)
    prefix, alike = np.zeros(mine.shape), np.ones(mine.shape, bool)
    for i in range(min(4, x.shape[1], y.shape[1])):
        alike &= (x[:, i, None] == y[None, :, i]) & (np.minimum(nx[:, None], ny[None, :]) > i)
        prefix += alike
    out = np.where(m > 0, jaro + prefix * scale * (1 - jaro), 0.0)
    return np.where((nx[:, None] == 0) & (ny[None, :] == 0), 1.0, out)


def _jaro(a: pa.Array, b: pa.Array) -> pa.Array:
    both = pc.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    out = np.zeros(len(a))
    longest = np.maximum(*(pc.utf8_length(t.fill_null("")).to_numpy(zero_copy_only=False) for t in (a, b)))
    short = np.flatnonzero(both & (longest <= _LONG))
    order = short[np.argsort(longest[short], kind="stable")]
    at = 0
    while at < len(order):
        # Pairs of about one length at a time, so that little is padded.
        stop = at + max(1, min(len(order) - at, _CELLS // max(1, int(longest[order[min(len(order) - 1, at + 4095)]]))))
        stop = min(stop, at + 4096)
        own = pa.array(order[at:stop])
        out[order[at:stop]] = jaro_winkler_pairs(a.take(own), b.take(own))
        at = stop
    for i in np.flatnonzero(both & (longest > _LONG)).tolist():
        out[i] = jaro_winkler_of(a[i].as_py(), b[i].as_py())
    return pa.array(out, pa.float64(), mask=~both)


_jaro.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity, which no built-in function has; by Arrow batches."""
    return F.arrow_udf(_jaro, "double")(a, b)
