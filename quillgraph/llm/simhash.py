"""Operator 2: SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint of ``BITS`` bits is cut into parts of correlated bits. Part i gets
a radius r_i >= -1 (-1: never probed). The parts' ``r_i + 1`` sum to
``MAX_DISTANCE + 1``, so any two fingerprints that differ in at most MAX_DISTANCE
bits agree to within the radius in at least one part: no pair is left out. The
number of parts and the radii are chosen by dynamic programming on the number of
candidate pairs that they would give, estimated from the value counts of all
fingerprints.

Only the first few bits of a value say to which task it goes, with as many of them
turned as the radius allows. All values in a task that agree to within the radius
are found there, by looking up the values around each: what is shuffled grows by
the turns of those few bits, not by all. A pair that meets is verified on all bits
at once, as rows carry whole fingerprints.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernels
from quillgraph.llm.common import free_name, strings
from quillgraph.operators.components import connected_components
from quillgraph.sources.staging import small_enough, stage

LONGS = 4
BITS = 64 * LONGS
#: Two documents whose fingerprints differ in at most so many bits are near-duplicates.
MAX_DISTANCE = 40
#: First bits of a part that choose the task of a probe, and rows of one bucket beyond which more bits choose.
TOP, BUCKET_ROWS = 6, 1 << 21
#: What a row that is shuffled and a value that is looked up cost, in pairs compared.
SHIPPED, LOOKUP = 15, 0.1
#: Greatest radius of a part: the values around one are listed.
MOST = 5
#: Pairs compared and values looked up at once.
PAIRS_AT_ONCE, VALUES_AT_ONCE = 1 << 18, 1 << 17
FP = [f"f{i}" for i in range(LONGS)]

_LANES = np.array([sum(((i >> k) & 1) << (8 * k) for k in range(8)) for i in range(256)], np.uint64)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows x LONGS) of texts by their distinct lower-case words, and whether each text has a word."""
    out, some = [], []
    for _, rows in kernels.slices(pc.utf8_lower(texts)):
        words = kernels.tokenize(rows)
        row = np.repeat(np.arange(len(rows), dtype=np.uint64), np.diff(words.row_at))
        key = kernels.distinct((row << np.uint64(44)) | (words.hash >> np.uint64(20)))
        n = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=len(rows))
        fp = np.zeros((len(rows), LONGS), np.uint64)
        live = np.flatnonzero(n)
        if len(live):
            at = np.concatenate([[0], np.cumsum(n[live])])[:-1]
            pieces = -(-n[live] // 255)  # eight-bit counters overflow beyond
            first = np.concatenate([[0], np.cumsum(pieces)])[:-1]
            inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
            starts = np.repeat(at, pieces) + 255 * inner
            word = key & np.uint64((1 << 44) - 1)
            for b in range(LONGS):
                lanes = kernels.mix(word * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b + 1)).view(np.uint8).reshape(-1, 8)
                for k in range(8):
                    ones = np.add.reduceat(_LANES[lanes[:, k]], starts).view(np.uint8).reshape(-1, 8)
                    ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
                    bits = np.packbits(2 * ones > n[live][:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)
                    fp[live, b] |= bits << np.uint64(8 * k)
        out.append(fp)
        some.append(n > 0)
    return (np.concatenate(out), np.concatenate(some)) if out else (np.zeros((0, LONGS), np.uint64), np.zeros(0, bool))


def _bits(columns: list[np.ndarray]) -> np.ndarray:
    """Bits of fingerprints, one row each, bit 0 of f0 first."""
    return np.unpackbits(np.stack(columns, axis=1).astype("<u8").view(np.uint8), axis=1, bitorder="little")


def _longs(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False).view(np.uint64) for f in FP]


def _summed(prints: DataFrame, count, size: int) -> np.ndarray:
    """``count(columns)`` gives ``size`` integers for some fingerprints; their sums over all, one row per task and place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                total += count(_longs(batch.slice(at, 8192)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.int64)
    rows = prints.select(*FP).mapInArrow(partial, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


_UPPER = np.triu_indices(BITS)


def _together(columns: list[np.ndarray]) -> np.ndarray:
    """How often each pair of bits is set in one fingerprint (both indices ascending; a bit with itself counts it)."""
    x = _bits(columns).astype(np.float32)
    return (x.T @ x)[_UPPER].astype(np.int64)


def correlated_order(together: np.ndarray, n: int) -> np.ndarray:
    """All bits, correlated ones beside each other: a greedy chain that decays as it goes."""
    m = np.zeros((BITS, BITS))
    m[_UPPER] = together / max(n, 1)
    m = np.maximum(m, m.T)
    p = np.diag(m)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((m - np.outer(p, p)) / np.outer(scale, scale))
    np.fill_diagonal(corr, -1)
    order = [int(np.argmax(corr.max(axis=1)))]
    free = np.ones(BITS, bool)
    free[order[0]] = False
    pull = corr[order[0]].copy()
    while len(order) < BITS:
        nxt = int(np.argmax(np.where(free, pull, -9.0)))
        order.append(nxt)
        free[nxt] = False
        pull = 0.8 * pull + corr[nxt]
    return np.array(order)


BLOCKS = BITS // 8


def _ordered(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of bytes with their bits in ``order``; distances stay as they are."""
    return np.ascontiguousarray(np.packbits(np.take(_bits(columns), order, axis=1), axis=1, bitorder="little"))


def plan_radii(counts: np.ndarray, n: int, reach: int = MAX_DISTANCE) -> tuple[int, list[int]]:
    """(blocks per part, radius of each part) of least estimated cost that find every pair within ``reach`` bits.

    Radii of parts with sum of (r + 1) = ``reach`` + 1 leave no pair out: if each
    part differed in r + 1 bits or more, the pair would differ in more than
    ``reach``. ``counts`` holds how often each block has each value. From them
    follows how many pairs differ in d bits of a block, exactly, and for a part by
    convolution of its blocks. The cost of a radius is the rows that it ships, the
    values that its tasks look up, and the pairs that agree to within it. best[b]
    is the least cost of radii with sum of (r + 1) = b.
    """
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    share = np.stack([np.bincount(apart.ravel(), np.outer(c, c).ravel(), 9) for c in counts.reshape(BLOCKS, 256).astype(np.float64)]) / max(n, 1) ** 2
    best: tuple[float, int, list[int]] | None = None
    for width in (2, 3, 4):
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for at in range(0, BLOCKS, width):
            part = range(at, min(at + width, BLOCKS))
            bits, dist = 8 * len(part), np.ones(1)
            for b in part:
                dist = np.convolve(dist, share[b])
            cost = [0.0]
            for r in range(MOST + 1):
                ship = sum(math.comb(TOP, k) / 2**k for k in range(min(r, TOP) + 1))
                cost.append(n * SHIPPED * ship + min(n, 1 << bits) * LOOKUP * _ball(bits, r) / 2 + 0.5 * n * n * dist[: r + 1].sum())
            step: dict[int, tuple[float, list[int]]] = {}
            for have, (paid, radii) in table.items():
                for r in range(-1, MOST + 1):
                    b, total = have + r + 1, paid + cost[r + 1]
                    if b <= reach + 1 and (b not in step or total < step[b][0]):
                        step[b] = (total, [*radii, r])
            table = step
        if best is None or table[reach + 1][0] < best[0]:
            best = (table[reach + 1][0], width, table[reach + 1][1])
    return best[1], best[2]


def _ball(bits: int, r: int) -> int:
    return sum(math.comb(bits, k) for k in range(r + 1))


@functools.lru_cache(64)
def _masks(bits: int, r: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``r`` of them set, ascending."""
    out = [np.zeros(1, np.int64)]
    last = {0: out[0]}
    for b in range(bits):
        # Those whose highest bit is b.
        new = {k + 1: v | (1 << b) for k, v in last.items() if k < r}
        last = {k: np.concatenate([x[k] for x in (last, new) if k in x]) for k in last.keys() | new.keys()}
    return np.sort(np.concatenate(list(last.values())))


class Probes:
    """Which bits make the parts, how far each is probed, and which first bits of a part choose the task."""

    def __init__(self, order: np.ndarray, width: int, radii: list[int], top: int = TOP):
        # The bits that choose the task lie apart in the order of correlation, so that tasks get equal shares.
        parts = [order[8 * at : 8 * min(at + width, BLOCKS)] for at in range(0, BLOCKS, width)]
        self.order = np.concatenate([np.concatenate([p[k :: len(p) // top] for k in range(len(p) // top)]) for p in parts])
        self.width, self.radii, self.top = width, radii, top
        self.bits = [len(p) for p in parts]
        #: More bits that choose where a bucket would hold too many rows, by part and first bits.
        self.more = np.zeros((len(parts), 1 << top), np.int64)

    def value(self, rows: np.ndarray, part: int) -> np.ndarray:
        """Values of a part of fingerprints in this order (rows of bytes), its first bits the lowest."""
        out = np.zeros(len(rows), np.int64)
        for k, b in enumerate(range(part * self.width, part * self.width + self.bits[part] // 8)):
            out |= rows[:, b].astype(np.int64) << (8 * k)
        return out

    def firsts(self, columns: list[np.ndarray]) -> np.ndarray:
        """How many fingerprints have each first bits of each part."""
        rows = _ordered(columns, self.order)
        at = [self.value(rows, i) % (1 << self.top) + (i << self.top) for i in range(len(self.bits))]
        return np.bincount(np.concatenate(at), minlength=self.more.size)

    def split(self, counts: np.ndarray, limit: int) -> None:
        """Lets more bits choose where more than ``limit`` rows would meet."""
        counts, code = counts.reshape(self.more.shape), np.arange(1 << self.top)
        for part, r in enumerate(self.radii):
            # Rows of a bucket by how many more of their bits may be turned.
            rows = np.zeros((r + 1, len(code)))
            for turned in code[np.bitwise_count(code) <= r]:
                at = code[code & turned == 0]
                rows[r - turned.bit_count(), at] += counts[part, at | turned]
            self.more[part] = self.bits[part] - self.top
            for more in range(self.bits[part] - self.top, -1, -1):
                # In the fullest of the buckets that it becomes.
                fullest = sum((rows[left] * _ball(more, left) / 2**more for left in range(r + 1)), np.zeros(len(code)))
                self.more[part, fullest <= limit] = more

    def buckets(self, value: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, bucket) of all probes of a part: part, first bits, and more of them in full buckets.

        Two values meet where the first bits are those that both have set, so each
        goes wherever up to as many of its set bits as the radius are turned.
        """
        top = self.top
        who, first, left = np.arange(len(value)), value & ((1 << top) - 1), np.full(len(value), self.radii[part])
        for b in range(top):
            on = np.flatnonzero(((first >> b) & 1 == 1) & (left > 0))
            who, first, left = np.concatenate([who, who[on]]), np.concatenate([first, first[on] ^ (1 << b)]), np.concatenate([left, left[on] - 1])
        more = self.more[part][first]
        bucket = ((np.int64(part) << top | first) << 28) | ((value[who] >> top) & ((1 << more) - 1))
        for b in range(int(more.max(initial=0))):
            on = np.flatnonzero((more > b) & ((bucket >> b) & 1 == 1) & (left > 0))
            who, bucket, left, more = np.concatenate([who, who[on]]), np.concatenate([bucket, bucket[on] ^ (1 << b)]), np.concatenate([left, left[on] - 1]), np.concatenate([more, more[on]])
        return who, bucket

    def ship(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow function: (id, f0..) to one row (bucket, id, f0..) per probe, with fingerprints in the order of parts."""
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                rows = _ordered(_longs(batch), self.order)
                longs = rows.view(np.int64)
                for i, r in enumerate(self.radii):
                    if r >= 0:
                        at, bucket = self.buckets(self.value(rows, i), i)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0).take(pa.array(at)), *[pa.array(longs[at, k]) for k in range(LONGS)]], ["bucket", "id", *FP])

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrow function on all rows of some buckets: verified edges (a, b)."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        ids = t.column("id").combine_chunks()
        bucket, fp = t.column("bucket").to_numpy(), np.stack([t.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)
        del t, held, batches
        order = np.argsort(bucket, kind="stable")
        for s, n in zip(*_bounds(bucket[order])):
            if n > 1:
                own = order[s : s + n]
                a, b = self.linked(int(bucket[own[0]]), fp[own])
                if len(a):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[a])), ids.take(pa.array(own[b]))], ["a", "b"])
        kernels.release()

    def linked(self, bucket: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that join all near pairs of a bucket that agree to within the radius.

        A pair meets in several buckets of a part; it is compared where no bit that
        chose the bucket is turned in both.
        """
        part, first = bucket >> (28 + self.top), (bucket >> 28) & ((1 << self.top) - 1)
        r, have = self.radii[part], self.top + int(self.more[part][first])
        rest = self.bits[part] - have
        value = self.value(fp.view(np.uint8).reshape(len(fp), -1), part)
        turned = (value & ((1 << have) - 1)) ^ (first | (bucket & ((1 << 28) - 1)) << self.top)
        key = turned << rest | value >> have
        order = np.argsort(key)
        key, rows = key[order], [fp[order, k] for k in range(LONGS)]
        start, size = _bounds(key)
        cell, groups = key[start] & ((1 << rest) - 1), key[start] >> rest
        at, many = _bounds(groups)
        sets = groups[at]
        forest = Forest(len(key))
        used = np.bitwise_count(sets)[:, None] + np.bitwise_count(sets)[None, :]
        for x, y in zip(*np.nonzero(np.triu((sets[:, None] & sets[None, :] == 0) & (used <= r)))):
            one, two = slice(at[x], at[x] + many[x]), slice(at[y], at[y] + many[y])
            if x == y:  # rows of one value
                row = np.arange(start[one][0], start[one][-1] + size[one][-1])
                _compare(rows, row, row + 1, np.repeat(start[one] + size[one], size[one]), forest)
            elif many[x] > many[y]:
                one, two = two, one
            for a, b in _near_values(cell[one], cell[two], rest, r - int(used[x, y]), x == y):
                row = np.repeat(start[one][a], size[one][a]) + _inner(size[one][a])
                low, high = start[two][b], start[two][b] + size[two][b]
                _compare(rows, row, np.repeat(low, size[one][a]), np.repeat(high, size[one][a]), forest)
        a, b = forest.edges()
        return order[a], order[b]


def _bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(key)]]))


def _inner(size: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, one run after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _near_values(one: np.ndarray, two: np.ndarray, bits: int, r: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in one, in two) of all values at most ``r`` bits apart; if both are the ``same``, each two different values once.

    Both are ascending and distinct. The values around each are looked up, or all
    are compared where these are fewer.
    """
    masks = _masks(bits, r)
    if len(two) <= len(masks):
        rows = max(1, VALUES_AT_ONCE // len(two))
        for at in range(0, len(one), rows):
            a, b = np.nonzero(np.bitwise_count(one[at : at + rows, None] ^ two[None, :]) <= r)
            if same:
                a, b = a[b > a + at], b[b > a + at]
            yield a + at, b
        return
    fold = min(bits, 20)
    held = np.zeros(1 << fold, bool)
    held[(two ^ (two >> fold)) & ((1 << fold) - 1)] = True
    # Of two different values, that without the highest bit that differs looks the other up.
    for h in range(bits) if same else (None,):
        who = np.arange(len(one)) if h is None else np.flatnonzero((one >> h) & 1 == 0)
        some = masks if h is None else masks[np.searchsorted(masks, 1 << h) : np.searchsorted(masks, 2 << h)]
        for left in range(0, len(who), VALUES_AT_ONCE):
            mine = who[left : left + VALUES_AT_ONCE]
            step = max(1, VALUES_AT_ONCE // len(mine))
            for low in range(0, len(some), step):
                sought = one[mine][:, None] ^ some[None, low : low + step]
                hit = np.flatnonzero(held[sought if bits <= fold else (sought ^ (sought >> fold)) & ((1 << fold) - 1)])
                value = sought.ravel()[hit]
                b = np.searchsorted(two, value)
                ok = two[np.minimum(b, len(two) - 1)] == value
                yield mine[hit[ok] // sought.shape[1]], b[ok]


def _compare(fp: list[np.ndarray], row: np.ndarray, low: np.ndarray, high: np.ndarray, forest: Forest) -> None:
    """Adds the near pairs of each row with those from ``low`` up to ``high``."""
    some = high > low
    row, low, high = row[some], low[some], high[some]
    total = np.concatenate([[0], np.cumsum(high - low)])
    at, due, many = 0, 0, total[-1] > len(forest.root)
    while at < len(row):
        if many and total[at] >= due:
            # Rows that are joined already need not be compared, so that a group of many copies takes little time.
            root = forest.roots()
            change = np.cumsum(np.concatenate([[0], root[1:] != root[:-1]]))
            left = at + np.flatnonzero((change[low[at:]] != change[high[at:] - 1]) | (root[low[at:]] != root[row[at:]]))
            row, low, high = row[left], low[left], high[left]
            total = np.concatenate([[0], np.cumsum(high - low)])
            at, due = 0, max(len(root), PAIRS_AT_ONCE)
            continue
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, "right")) - 1)
        n = (high - low)[at:stop]
        a, b = np.repeat(row[at:stop], n), np.arange(total[at], total[stop]) + np.repeat(low[at:stop] - total[at:stop], n)
        if many:
            left = np.flatnonzero(root.take(a) != root.take(b))
            a, b = a[left], b[left]
        apart = np.bitwise_count(fp[0].take(a) ^ fp[0].take(b))
        for k in range(1, LONGS):
            apart = apart + np.bitwise_count(fp[k].take(a) ^ fp[k].take(b))
            near = np.flatnonzero(apart <= MAX_DISTANCE)
            a, b, apart = a[near], b[near], apart[near]
        forest.add(a, b)
        at = stop


class Forest:
    """Edges that join what all pairs added so far join, fewer than there are rows."""

    def __init__(self, n: int):
        self.root, self.kept, self.new, self.waiting = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.new.append((a, b))
            self.waiting += len(a)
            if self.waiting > PAIRS_AT_ONCE:
                self.roots()

    def roots(self) -> np.ndarray:
        """Of each row the same for all that are joined."""
        if not self.new:
            return self.root
        a, b = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.waiting = [], 0
        while True:
            x, y = self.root[a], self.root[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return self.root
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            # Each root takes one lesser root as its own, so there is no cycle.
            high, edge = np.unique(high, return_index=True)
            self.kept.append((a[edge], b[edge]))
            self.root[high] = low[edge]
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self.roots()
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate(x) for x in zip(*self.kept))
        return a, b


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, kept_id)`` for every document that another one stands for.

    Documents linked by a chain of steps of at most MAX_DISTANCE bits form a
    group, in which the least ``doc_id`` is kept; keys keep their type and order.
    Every document is a query; no pair within MAX_DISTANCE is left out, and each is
    verified on all bits. Texts without a
    word (null, empty, only punctuation) and rows with a null key are compared
    with nothing. Rows with one key are one document: none of them is named as
    another's copy, and if their texts differ all their groups are joined. An
    empty table gives no rows. Texts of any length are read whole; one text must
    fit a worker, with about ten times its size beside it. Buckets of more than
    ``bucket_rows`` rows are split by further bits, with the same result.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, some = fingerprints(strings(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(fp[:, i].view(np.int64)) for i in range(LONGS)]], ["doc_id", *FP]).filter(pa.array(some))

    longs, kind = ", ".join(f"{f} long" for f in FP), docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    each = stage(source.mapInArrow(prints, f"doc_id {kind}, {longs}"))
    unique = stage(each.groupBy(*FP).agg(F.min("doc_id").alias("id")).select("id", *FP))
    n = unique.count()
    order = correlated_order(_summed(unique, _together, len(_UPPER[0])), n)
    counts = _summed(unique, lambda c: np.bincount((_ordered(c, order) + 256 * np.arange(BLOCKS)).ravel(), minlength=256 * BLOCKS), 256 * BLOCKS)
    probes = Probes(order, *plan_radii(counts, n))
    probes.split(_summed(unique, probes.firsts, probes.more.size), bucket_rows)
    shipped = unique.mapInArrow(probes.ship, f"bucket long, id {kind}, {longs}").repartition("bucket")
    edges = shipped.mapInArrow(probes.meet, f"a {kind}, b {kind}")
    # A document whose rows have several texts joins their groups.
    firsts = each.join(unique, FP).select("doc_id", "id")
    linked = firsts.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    groups = connected_components(edges.union(linked))
    return groups.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` whose document is kept by :func:`near_duplicates`, columns unchanged; rows with a null key stay."""
    (gone_id,) = free_name(docs, "gone_id")
    gone = stage(near_duplicates(docs, key, text).select(F.col("doc_id").alias(gone_id)))
    side = F.broadcast(gone) if small_enough(gone, broadcast_rows) else gone
    return docs.join(side, F.col(key) == F.col(gone_id), "left_anti")
