"""Scores of extraction, resolution and answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.tiles import matrix

def guarded(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def prf(rows: DataFrame, empty: float = 0.0, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of ``(truth, predicted)`` booleans, of which a row stands for ``n``; an empty denominator gives ``empty``."""
    t, p = F.col("truth"), F.col("predicted")
    if n is None:
        count = F.count_if
    else:
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0))
    counts = rows.groupBy(*(by or [])).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    precision, recall = guarded(F.col("tp"), F.col("tp") + F.col("fp"), empty), guarded(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    return counts.withColumns({"precision": precision, "recall": recall, "f1": guarded(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), empty)})


def ranked(scored: DataFrame, label: str, score: str, order: list[str]) -> DataFrame:
    """``scored`` with ``rank`` by descending score within a label, ties by ``order``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc(score), *order)))


def pairs_of_a_kind(rows: DataFrame) -> DataFrame:
    """``(total)``: pairs of rows ``(id, kind)`` of one kind and different ids, counted without listing them."""
    each = rows.where("id is not null and kind is not null").groupBy("kind", "id").agg(F.count("*").alias("c"))
    per = each.groupBy("kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return per.agg(F.coalesce(F.sum(((F.col("n") * F.col("n") - F.col("own")) / 2).cast("long")), F.lit(0)).alias("total"))


def recall_at(ranks: DataFrame, most: int = 10, total: DataFrame | None = None) -> DataFrame:
    """``(k, recall)``: share of true rows ``(truth, rank)`` of rank k at most, up to the first k that has all.

    ``total``: how many true rows there are, where ``ranks`` hold only those of the first ranks.
    """
    total = ranks.where("truth").agg(F.count("*").alias("total")) if total is None else total
    per = ranks.where(F.col("truth") & (F.col("rank") <= most)).groupBy("rank").agg(F.count("*").alias("n"))
    grid = ranks.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("k"))
    got = grid.join(F.broadcast(per), F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(total)
    out = got.select("k", guarded(F.col("n"), F.col("total")).alias("recall"))
    done = F.max(F.when(F.col("recall") >= 1.0, 1).otherwise(0)).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("done", done).where("coalesce(done, 0) = 0").drop("done")


def set_scores(gold: DataFrame, pred: DataFrame, keys: list[str], group: str) -> DataFrame:
    """One row of counts and scores of distinct ``keys`` per group, summed over groups that both sides have."""
    groups = gold.select(group).distinct().join(pred.select(group).distinct(), group, "left_semi")
    g = gold.select(group, *keys).distinct().join(groups, group, "left_semi").withColumn("g", F.lit(1))
    p = pred.select(group, *keys).distinct().join(groups, group, "left_semi").withColumn("p", F.lit(1))
    on = [g[c].eqNullSafe(p[c]) for c in [group, *keys]]
    both = g.join(p, on, "full_outer").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    s = both.agg(F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"))
    precision, recall = guarded(F.col("tp"), F.col("n_pred")), guarded(F.col("tp"), F.col("n_gold"))
    return s.withColumns({"precision": precision, "recall": recall, "f1": guarded(2 * F.col("tp"), F.col("n_pred") + F.col("n_gold"))})


def max_pool(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``(key, pooled)``: the greatest value at each place over a key's vectors; partial maxima are combined per place."""
    each = vectors.select(key, F.posexplode(vec).alias("at", "x")).groupBy(key, "at").agg(F.max("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("pooled"))


def best_assignment(value: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total value, one partner each: shortest augmenting paths with potentials."""
    if not value.size:
        return []
    flip = value.shape[0] > value.shape[1]
    cost = -(value.T if flip else value)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        owner[m], at = i, m
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            reduced = cost[row] - u[row] - v[:m]
            better = ~done[:m] & (reduced < least)
            least[better], via[better] = reduced[better], at
            nxt = int(np.argmin(np.where(done[:m], np.inf, least)))
            step = least[nxt]
            u[owner[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = nxt
        while at != m:
            owner[at] = owner[via[at]]
            at = int(via[at])
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


#: Cells of a matrix of values up to which it is kept; larger ones are computed row by row as they are needed.
DENSE = 1 << 20


def best_partners_of(x: np.ndarray, y: np.ndarray, dense: int = DENSE) -> list[tuple[int, int]]:
    """:func:`best_assignment` of ``x @ y.T``, in memory that grows with the rows and not with their product.

    Free rows bid for their best column by as much as it is better than their second
    best, many rows at once; a column goes to the highest bid, and its former row
    is free again. The prices stay optimal for the rows that have a column, and
    what bids don't settle is settled by shortest augmenting paths as there.
    """
    if len(x) * len(y) <= dense:
        return best_assignment(x @ y.T)
    flip = len(x) > len(y)
    if flip:
        x, y = y, x
    n, m = len(x), len(y)
    v, owner, mate = np.zeros(m), np.full(m + 1, -1), np.full(n, -1)
    light = np.ascontiguousarray(y.T)
    some = max(1, (1 << 22) // m)
    free, rounds, bids = np.arange(n), 0, 0
    while len(free) > max(8, n // 200) and rounds < 4000 and bids < 40 * n:
        rounds += 1
        bidders = free[:some]
        bids += len(bidders)
        cost = -(x[bidders] @ light) - v
        at = np.arange(len(bidders))
        best = cost.argmin(axis=1)
        low = cost[at, best].copy()
        cost[at, best] = np.inf
        gain = cost.min(axis=1) - low
        order = np.lexsort((bidders, -gain, best))
        won = order[np.unique(best[order], return_index=True)[1]]
        col, row = best[won], bidders[won]
        gone = owner[col]
        mate[gone[gone >= 0]] = -1
        v[col] -= gain[won]
        owner[col], mate[row] = row, col
        # Rows that were outbid go to the end, so that all have their turn.
        free = np.concatenate([free[some:], bidders[mate[bidders] < 0], gone[gone >= 0]])
    v = np.append(v, 0.0)
    u = np.zeros(n)
    for i in np.flatnonzero(mate >= 0):
        u[i] = -(x[i] @ y[mate[i]]) - v[mate[i]]
    for i in np.flatnonzero(mate < 0):
        owner[m], at = i, m
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        u[i] = (-(x[i] @ light) - v[:m]).min()
        behind, reached = 0.0, []
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            reduced = -(x[row] @ light) - u[row] - v[:m] + behind
            better = ~done[:m] & (reduced < least)
            least[better], via[better] = reduced[better], at
            reached.append((at, behind))
            at = int(np.argmin(np.where(done[:m], np.inf, least)))
            behind = float(least[at])
        for j, far in reached:
            u[owner[j]] += behind - far
            v[j] -= behind - far
        v[m] = 0.0
        while at != m:
            owner[at] = owner[via[at]]
            at = int(via[at])
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def assigned(gold: DataFrame, pred: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(grp, gold_id, pred_id, similarity)`` of the best one-to-one assignment per group, by cosine, at the threshold or above.

    Inputs are ``(grp, id, vec)``, ids not null. Groups of one side only give nothing.
    """

    kinds = dict(gold.dtypes)

    def solve(t: pa.Table) -> pa.Table:
        a, b = t.filter(pc.field("pred_id").is_null()).sort_by("gold_id"), t.filter(pc.field("pred_id").is_valid()).sort_by("pred_id")
        keep: list[tuple[int, int]] = []
        if len(a) and len(b):
            x, y = (matrix(side.column("vec")) for side in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
            found = best_partners_of(x, y)
            sim = {(i, j): float(x[i] @ y[j]) for i, j in found}
            keep = [k for k in found if sim[k] >= threshold]
        i, j = (pa.array([k[side] for k in keep], pa.int64()) for side in (0, 1))
        return pa.table({"grp": a.column("grp").take(i), "gold_id": a.column("gold_id").take(i), "pred_id": b.column("pred_id").take(j), "similarity": pa.array([float(sim[k]) for k in keep], pa.float64())})

    both = gold.select("grp", F.col("id").alias("gold_id"), "vec").unionByName(pred.select("grp", F.col("id").alias("pred_id"), "vec"), allowMissingColumns=True)
    return both.groupBy("grp").applyInArrow(solve, f"grp {kinds['grp']}, gold_id {kinds['id']}, pred_id {dict(pred.dtypes)['id']}, similarity double")


def accuracy(answers: DataFrame, kind: str, right: str) -> DataFrame:
    """``(kind, n, accuracy)`` in percent, with a row of a null kind for all."""
    each = answers.groupBy(F.col(kind).cast("string").alias("kind"))
    pick = [F.count("*").alias("n"), F.round(F.avg(F.col(right).cast("double")) * 100, 2).alias("accuracy")]
    return each.agg(*pick).union(answers.agg(F.lit(None).cast("string").alias("kind"), *pick))
