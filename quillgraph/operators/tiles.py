"""Work on all pairs of rows of a group, tile by tile, that keeps sums or the best of each row and not the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.staging import small_enough, stage

#: Rows and columns of a product at a time, so that it stays in a core's cache.
ROWS, COLS = 128, 1024
#: Numbers of the vectors of a block, tasks wanted, and most of them.
CELLS, TILES, TASKS = 1 << 22, 256, 2000


def tiles(rows: DataFrame, block: int | None = None, width: Column | None = None, least: int = 1024) -> DataFrame:
    """``rows(_k, id, ...)`` sent to the tiles ``(_k, _i, _j)`` of their group: its rows lie in blocks ``_b`` by a hash of their id, and every two blocks are a tile.

    Blocks are as large as leaves work for many tasks, but not over ``CELLS``
    numbers of ``width`` a row: a row is sent as often as its group has blocks.
    Each tile or few are a task, which isn't merged with others for having little
    to read.
    """
    n = stage(rows.groupBy("_k").agg(F.count("*").alias("_c"), F.max(F.coalesce(width, F.lit(1)) if width is not None else F.lit(1)).alias("_w")))
    size = F.col("_c").cast("double")
    got = n.agg(F.sum(size * size).alias("pairs"), F.max("_w").alias("width")).first()
    if block is None:
        block = int(max(1, min(max(least, ((got["pairs"] or 0) / TILES) ** 0.5), max(1, CELLS // max(1, got["width"] or 1)))))
    n = n.select(F.col("_k").alias("_kn"), F.ceil(F.col("_c") / F.lit(block)).cast("int").alias("_n"))
    many = n.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") + 1) / 2)).first()[0] or 1
    side = F.broadcast(n) if small_enough(n, 100_000) else n
    placed = rows.join(side, F.col("_k").eqNullSafe(F.col("_kn"))).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    sent = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", *rows.columns)
    return sent.repartition(int(max(1, min(many, TASKS))), "_k", "_i", "_j")


def by_tile(sent: DataFrame, run: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.Table]], schema: str) -> DataFrame:
    """What ``run(table, low, high)`` yields for each tile: its rows by id, and the places of those of either block, the same of one block with itself."""

    def each(batches):
        t = pa.Table.from_batches(list(batches))
        t = t.sort_by("id").combine_chunks()
        i, j, at = t.column("_i")[0].as_py(), t.column("_j")[0].as_py(), t.column("_b").to_numpy()
        low, high = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if len(low) and len(high):
            for out in run(t, low, high):
                yield from out.to_batches()

    each.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return sent.groupBy("_k", "_i", "_j").applyInArrow(each, schema)


def matrix(vec: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, one row each; a null vector or number counts as zero."""
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    size = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(size > 0)
    out = np.zeros((len(vec), int(size.max(initial=0))))
    if len(own):
        flat = vec.flatten()
        out[own] = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(len(own), -1)
    return out


def _places(t: pa.Table, name: str) -> np.ndarray:
    """Numbers of the values of a sorted column, equal ones alike."""
    code = t.column(name).combine_chunks().dictionary_encode()
    return code.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _kinded(rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows by kind, those without one last, and where these begin."""
    order = rows[np.lexsort((kind[rows], kind[rows] < 0))]
    return order, int((kind[rows] >= 0).sum())


def _cuts(n: int, step: int, also: int) -> list[tuple[int, int]]:
    edges = sorted({0, n, also, *range(0, n, step)})
    return list(zip(edges, edges[1:]))


def score_classes(vectors: DataFrame, classes: Callable[[np.ndarray], np.ndarray], kinds: bool = False, block: int | None = None) -> DataFrame:
    """``(same, class, n)``: how many pairs of rows ``(id, kind, vec)`` have a score of each class, and whether their kinds are the same.

    A score is the inner product with six decimals, from 0 to 1; ``classes`` gives
    whole numbers from 0 on for an array of such. ``kinds``: only pairs of one kind
    are made; null is then a kind as well, else ``same`` is null where a kind is.
    A tile is summed up where it is computed, so that it sends a row for a class.
    """
    own = vectors.select("id", "kind", "vec", (F.col("kind") if kinds else F.lit(0)).alias("_k"))

    def count(t: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.Table]:
        x, ids = matrix(t.column("vec")), _places(t, "id")
        kind = np.zeros(len(x), np.int64) if kinds else _places(t, "kind")
        table = np.asarray(classes(np.arange(1_000_001) / 1e6)).astype(np.int32)
        void = int(table.max()) + 1
        alone, one = np.array_equal(low, high), len(np.unique(ids)) == len(ids)
        (low, low_valid), (high, high_valid) = _kinded(low, kind), _kinded(high, kind)
        total = {k: np.zeros(void + 1, np.int64) for k in (True, False, None)}
        spare = np.empty(ROWS * COLS)
        for a, b in _cuts(len(low), ROWS, low_valid):
            xa, ka = x[low[a:b]], kind[low[a:b]]
            for c, d in _cuts(len(high), COLS, high_valid):
                if alone and d <= a + 1:
                    continue
                score = np.matmul(xa, x[high[c:d]].T, out=spare[: (b - a) * (d - c)].reshape(b - a, d - c))
                score *= 1e6
                np.rint(score, out=score)
                np.fmin(score, 1e6, out=score)  # what is no number counts as the greatest
                np.fmax(score, 0, out=score)
                cls = table[score.astype(np.int32)]
                if alone and c < b:
                    cls[np.arange(a, b)[:, None] >= np.arange(c, d)[None, :]] = void
                if alone and not one:
                    cls[ids[low[a:b], None] == ids[high[c:d]][None, :]] = void
                every = np.bincount(cls.ravel(), minlength=void + 1)
                if a >= low_valid or c >= high_valid:
                    total[None] += every
                    continue
                kc, same = kind[high[c:d]], np.zeros(void + 1, np.int64)
                for k in np.intersect1d(ka, kc):
                    r, s = np.searchsorted(ka, [k, k + 1]), np.searchsorted(kc, [k, k + 1])
                    same += np.bincount(cls[r[0] : r[1], s[0] : s[1]].ravel(), minlength=void + 1)
                total[True] += same
                total[False] += every - same
        for k, n in total.items():
            own = np.flatnonzero(n[:void])
            yield pa.table({"same": pa.array([k] * len(own), pa.bool_()), "class": pa.array(own, pa.int64()), "n": pa.array(n[own], pa.int64())})

    found = by_tile(tiles(own, block, F.size("vec")), count, "same boolean, class long, n long")
    return found.groupBy("same", "class").agg(F.sum("n").alias("n"))


def _best(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, floor: float, later: bool, clamped: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, column, score)`` of the ``k`` best columns of each row whose score is above ``floor``, among equals those of least id; ``rows`` and ``cols`` by id.

    Products in single precision pass over what can't be among the best; scores
    of the rest are computed in double precision.
    """
    light = x.astype(np.float32)
    long = float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
    slack = (x.shape[1] + 4) * 2.0**-23 * long * long + 1e-6
    for a in range(0, len(rows), ROWS * 4):
        r = rows[a : a + ROWS * 4]
        kth, found = np.full(len(r), floor), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for c in range(int(np.searchsorted(ids[cols], ids[r[0]], "right")) if later else 0, len(cols), COLS):
            q = cols[c : c + COLS]
            score = light[r] @ light[q].T
            if later and ids[q[0]] <= ids[r[-1]]:
                barred = ids[q][None, :] <= ids[r][:, None]
            elif not later and ids[q[0]] <= ids[r[-1]] and ids[q[-1]] >= ids[r[0]]:
                barred = ids[q][None, :] == ids[r][:, None]
            else:
                barred = None
            if barred is not None:
                score[barred] = -np.inf
            bound = kth - slack
            if len(q) > k and not np.isfinite(kth).all():
                # Of columns that are the first, at least k have such a score.
                start = np.partition(score, len(q) - k, axis=1)[:, len(q) - k] - 2 * slack
                start = np.minimum(start, 1 - 2 * slack) if clamped else start
                bound = np.where(np.isfinite(kth) | (clamped & (start <= 0)), bound, start)
            good = ~(score <= bound.astype(np.float32)[:, None])
            if barred is not None:
                good &= ~barred
            i, j = np.divmod(np.flatnonzero(good), len(q))
            if not len(i):
                continue
            exact = np.concatenate([np.einsum("ij,ij->i", x[r[i[s : s + 65536]]], x[q[j[s : s + 65536]]]) for s in range(0, len(i), 65536)])
            exact = np.round(exact, 6)
            if clamped:
                exact = np.fmax(np.fmin(exact, 1.0), 0.0)
            new = exact > kth[i]
            i, j, exact = i[new], j[new] + c, exact[new]
            if not len(i):
                continue
            i, j, exact = (np.concatenate(z) for z in zip(found, (i, j, exact)))
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            kth[i[rank == k - 1]] = exact[rank == k - 1]
            keep = rank < k
            found = [i[keep], j[keep], exact[keep]]
        yield r[found[0]], cols[found[1]], found[2]


def best_partners(vectors: DataFrame, k: int, floor: float = -np.inf, kinds: bool = True, later: bool = False, clamped: bool = False, block: int | None = None) -> DataFrame:
    """``(kind, id, other_kind, other, score, rank)``: of each row ``(id, kind, vec)`` the ``k`` partners of greatest score above ``floor``, among equals those of least id.

    ``kinds``: partners of one kind only; ``later``: of a greater id only;
    ``clamped``: scores count from 0 to 1. A tile sends the best of its rows, so
    that what is shuffled grows with the rows and blocks, not with the pairs.
    """
    own = vectors.where("id is not null and vec is not null").select("id", "kind", "vec", (F.col("kind") if kinds else F.lit(0)).alias("_k"))
    types = dict(vectors.dtypes)

    def best(t: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.Table]:
        x, ids = matrix(t.column("vec")), _places(t, "id")
        for rows, cols in [(low, high)] if np.array_equal(low, high) else [(low, high), (high, low)]:
            for i, j, score in _best(x, ids, rows, cols, k, floor, later, clamped):
                i, j = pa.array(i), pa.array(j)
                yield pa.table({"kind": t.column("kind").take(i), "id": t.column("id").take(i), "other_kind": t.column("kind").take(j), "other": t.column("id").take(j), "score": pa.array(score)})

    found = by_tile(tiles(own, block, F.size("vec")), best, f"kind {types['kind']}, id {types['id']}, other_kind {types['kind']}, other {types['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
