"""Entity resolution: contexts, blocking by similarity, thresholds, and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import name_words, names_overlap
from quillgraph.functions.vectors import _jaro, jaro_winkler, jaro_winkler_table
from quillgraph.operators.tiles import best_partners, by_tile, score_classes, tiles
from quillgraph.sources.corpus import numbered
from quillgraph.sources.staging import small_enough, stage


def strict_gate(a: Column, b: Column, fields: tuple[str, ...] = ("taskDate", "personEmail")) -> Column:
    """Whether two property maps agree on all ``fields``; both missing agree, one missing doesn't."""
    out = F.lit(True)
    for f in fields:
        out = out & a[f].eqNullSafe(b[f])
    return out


def contexts(relations: DataFrame, entities: DataFrame, default: str = "Missing") -> DataFrame:
    """``(id, context)``: the contexts of an entity's relations in order of ``rid``, start before end, joined by bars."""
    ends = relations.where(F.trim(F.coalesce("context", F.lit(""))) != "").select("rid", "context", F.posexplode(F.array("start", "end")).alias("pos", "id"))
    each = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rid", "pos", "context"))).alias("c"))
    joined = each.select("id", F.array_join(F.transform("c", lambda x: x["context"]), " | ").alias("context"))
    return entities.select("id").join(joined, "id", "left").select("id", F.coalesce("context", F.lit(default)).alias("context"))


#: Rows of a block of vectors; a task multiplies two blocks.
BLOCK = 1024


def _block_products(vectors: DataFrame, kinds: bool, keep, block: int) -> DataFrame:
    """``(kind1, kind2, id1, id2, score)``, ``id1 < id2``, of all pairs of rows ``(id, kind, vec)`` (``kinds``: of one kind only) for whose scores ``keep`` holds.

    Rows are spread over blocks of about ``block`` by a hash of their id, and each
    pair of blocks is one product of matrices in one task: a kind of any size is
    cut into as many tasks as it has pairs of blocks.
    """
    own = vectors.select("id", "kind", "vec", *([F.col("kind").alias("_k")] if kinds else [F.lit(0).alias("_k")]))
    n = stage(own.groupBy("_k").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_n"))).select(F.col("_k").alias("_kn"), "_n")
    side = F.broadcast(n) if small_enough(n, 100_000) else n
    placed = own.join(side, F.col("_k").eqNullSafe(F.col("_kn"))).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    sent = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_k", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "id", "kind", "vec")
    types = dict(vectors.dtypes)

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        vec, at = t.column("vec").combine_chunks(), t.column("_b").to_numpy()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1) if len(vec) else np.zeros((0, 1))
        low, high = np.flatnonzero(at == at.min()), np.flatnonzero(at == at.max())
        score = np.round(x[low] @ x[high].T, 6)
        good = keep(score)
        if t.column("_i")[0].as_py() == t.column("_j")[0].as_py():
            good &= low[:, None] < high[None, :]
        elif at.min() == at.max():
            good[:] = False  # the other block is empty
        a, b = np.nonzero(good)
        first, second = pa.array(np.minimum(low[a], high[b])), pa.array(np.maximum(low[a], high[b]))
        kind, ids = t.column("kind"), t.column("id")
        return pa.table({"kind1": kind.take(first), "kind2": kind.take(second), "id1": ids.take(first), "id2": ids.take(second), "score": pa.array(score[a, b])})

    return sent.groupBy("_k", "_i", "_j").applyInArrow(product, f"kind1 {types['kind']}, kind2 {types['kind']}, id1 {types['id']}, id2 {types['id']}, score double")


def all_pairs(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(kind1, kind2, id1, id2, score)`` of every two rows ``(id, kind, vec)``, ``id1 < id2``, with their inner product."""
    return _block_products(vectors, False, lambda s: np.ones(s.shape, bool), block)


def similar_pairs(vectors: DataFrame, threshold: float, strict: bool = True, block: int = BLOCK) -> DataFrame:
    """``(kind, id1, id2, score)``, ``id1 < id2``, of rows ``(id, kind, vec)`` whose exact inner product passes the threshold.

    Every row meets every later one of its kind, block by block. ``strict`` keeps
    scores above it, else also those at it. A row's own copy is no pair of it;
    equal vectors are.
    """
    found = _block_products(vectors, True, (lambda s: s > threshold) if strict else (lambda s: s >= threshold), block)
    return found.select(F.col("kind1").alias("kind"), "id1", "id2", "score")


def nearest_pairs(vectors: DataFrame, k: int, threshold: float, strict: bool = True) -> DataFrame:
    """Of each row its ``k`` best partners of its kind above the threshold; a pair that both ends find is one."""
    best = best_partners(vectors, k, threshold if strict else float(np.nextafter(threshold, -np.inf)))
    return best.groupBy("kind", F.least("id", "other").alias("id1"), F.greatest("id", "other").alias("id2")).agg(F.max("score").alias("score"))


def _steps(score: np.ndarray, top: int) -> np.ndarray:
    """The last of ``top`` steps from 0 to 1 that scores pass."""
    return np.minimum(np.floor(score * top + 1e-9), top).astype(np.int64)


def threshold_sweep(scored: DataFrame, points: int = 1000) -> DataFrame:
    """``(point, threshold, tp, predicted, actual, precision, recall)`` of ``score >= threshold`` at each of ``points`` steps from 0 to 1.

    Scores are binned to the steps that they pass, then summed from above: one
    aggregation, whatever the number of rows. Nothing predicted has precision 1.
    """
    top = points - 1
    return _sweep(scored.select(F.least(F.floor(F.col("score") * top + F.lit(1e-9)), F.lit(top)).alias("bin"), F.col("truth").cast("int").alias("truth")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("truth").alias("t")), points)


def _sweep(bins: DataFrame, points: int) -> DataFrame:
    """:func:`threshold_sweep` of ``bins(bin, n, t)``: scores of a step and the true ones among them."""
    top = points - 1
    grid = bins.sparkSession.range(points).select(F.col("id").alias("bin"))
    bins = stage(bins)
    actual = bins.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("actual"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(bins, "bin", "left").select("bin", F.sum(F.coalesce("t", F.lit(0))).over(above).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(above).alias("predicted"))
    out = out.crossJoin(F.broadcast(actual))
    return out.select(F.col("bin").alias("point"), (F.col("bin") / top).alias("threshold"), "tp", "predicted", "actual", F.coalesce(F.try_divide("tp", "predicted"), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0)).alias("recall"))


def pair_sweep(vectors: DataFrame, points: int = 1000) -> DataFrame:
    """:func:`threshold_sweep` over all pairs of rows ``(id, kind, vec)``, true where their kinds are the same; no pair is listed."""
    counts = score_classes(vectors, lambda s: _steps(s, points - 1))
    return _sweep(counts.groupBy(F.col("class").alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n"))).alias("t")), points)


def kind_sweep(vectors: DataFrame, above: float, points: int = 1000) -> DataFrame:
    """:func:`threshold_sweep` over all pairs of one kind, true where their score is above a value; no pair is listed."""
    counts = score_classes(vectors, lambda s: _steps(s, points - 1) * 2 + (s > above), kinds=True)
    bins = counts.select(F.floor(F.col("class") / 2).alias("bin"), "n", F.when(F.col("class") % 2 == 1, F.col("n")).alias("t"))
    return _sweep(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), points)


def thresholds(sweep: DataFrame, precision: float = 0.98, recall: float = 0.99) -> DataFrame:
    """``(auto_match, auto_reject)``: the least threshold of such precision and any recall, the greatest of such recall; null without one."""
    return sweep.agg(F.min(F.when((F.col("precision") >= precision) & (F.col("recall") > 0), F.col("threshold"))).alias("auto_match"), F.max(F.when(F.col("recall") >= recall, F.col("threshold"))).alias("auto_reject"))


def remap_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges between canonical ids, without loops, the first by ``rid`` of those equal in ends, relation and context."""
    c1, c2 = canonical.select(F.col("node").alias("start"), F.col("component").alias("c1")), canonical.select(F.col("node").alias("end"), F.col("component").alias("c2"))
    out = edges.join(c1, "start", "left").join(c2, "end", "left").withColumn("start", F.coalesce("c1", "start")).withColumn("end", F.coalesce("c2", "end"))
    out = out.where("start is null or end is null or start <> end")
    others = [c for c in edges.columns if c not in ("start", "end", "relation", "context", "rid")]
    firsts = out.groupBy("start", "end", "relation", "context").agg(F.min(F.struct("rid", *others)).alias("f"))
    return firsts.select("start", "end", "relation", "context", "f.*").select(*edges.columns)


def merge_properties(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(id, props)`` per cluster: the canonical entity's properties, others from the least id that has them."""
    rows = entities.join(canonical, entities.id == canonical.node, "left").select(F.coalesce("component", "id").alias("canon"), "id", F.explode_outer("props").alias("k", "v"))
    best = rows.groupBy("canon", "k").agg(F.min_by("v", F.struct((F.col("id") != F.col("canon")).alias("other"), "id")).alias("v"))
    return best.groupBy(F.col("canon").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("props"))


def _runs(name: Column, k: int) -> Column:
    """Runs of ``k`` letters of a name in lower case; none of a shorter one."""
    low = F.lower(F.trim(name))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (k - 1))), lambda i: F.substring(low, i, k))
    return F.when(F.length(low) >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def overlapping_names(a: DataFrame, b: DataFrame, small: int = 10_000) -> DataFrame:
    """``(id1, id2)`` of ``a(id, name)`` and ``b(id, name)`` whose names overlap (:func:`names_overlap`).

    Up to ``small`` rows of ``b`` are broadcast and tested whole. More meet ``a`` by
    equi-joins on keys, then by the exact test: a word of both; the first four
    letters of the second name within the first; the first four letters of the
    first name, or all of a shorter one, within the second.
    """
    x, y = a.select(F.col("id").alias("id1"), F.col("name").alias("n1")), b.select(F.col("id").alias("id2"), F.col("name").alias("n2"))
    exact = names_overlap(F.col("n1"), F.col("n2"))
    if small_enough(y, small):
        return x.join(F.broadcast(y), exact).select("id1", "id2")

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(tag), v))

    head = lambda c: F.array(F.substring(F.lower(F.trim(c)), 1, 4))
    left = F.concat(tagged("word:", name_words(F.col("n1"))), tagged("in1:", _runs(F.col("n1"), 4)), tagged("in2:", head(F.col("n1"))))
    right = F.concat(tagged("word:", name_words(F.col("n2"))), tagged("in1:", head(F.col("n2"))), *[tagged("in2:", _runs(F.col("n2"), k)) for k in (1, 2, 3, 4)])
    keyed = x.withColumn("k", F.explode(F.array_distinct(left))).join(y.where(F.length(F.trim("n2")) >= 4).withColumn("k", F.explode(F.array_distinct(right))), "k")
    return keyed.where(exact).select("id1", "id2").distinct()


def _parts_within(name: Column, lengths: Column) -> Column:
    """All that stands within a name and has one of ``lengths``, once each."""
    of = lambda k: F.when(k <= F.length(name), F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(name, i, k)))
    return F.array_distinct(F.flatten(F.filter(F.transform(lengths, of), lambda x: x.isNotNull())))


def first_overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(name, first)``: of each name of ``a(name)`` the least ``first`` of ``b(name, first)`` whose name overlaps (:func:`names_overlap`).

    Names count in lower case without blanks around them. Pairs aren't listed:
    the least is sought for each distinct name, word and part of a name, then for
    the names that have it, so that the work grows with the names and not with
    their overlaps. Only parts as long as a name of the other side are cut out.
    """
    low = F.lower(F.trim("name")).alias("n")
    x = stage(a.select("name", low).where("n <> ''").distinct())
    y = stage(b.select(low, "first").where("length(n) >= 4").groupBy("n").agg(F.min("first").alias("first")))
    names = x.select("n").distinct()

    def lengths(of: DataFrame) -> DataFrame:
        return F.broadcast(of.agg(F.coalesce(F.collect_set(F.length("n")), F.array().cast("array<int>")).alias("lengths")))

    def least(keyed: DataFrame) -> DataFrame:
        return keyed.groupBy("k").agg(F.min("first").alias("first"))

    word = names.select("n", F.explode(F.array_distinct(name_words(F.col("n")))).alias("k")).join(least(y.select(F.explode(F.array_distinct(name_words(F.col("n")))).alias("k"), "first")), "k")
    within = names.crossJoin(lengths(y)).select("n", F.explode(_parts_within(F.col("n"), F.col("lengths"))).alias("k")).join(y.withColumnRenamed("n", "k"), "k")
    around = names.withColumn("k", F.col("n")).join(least(y.crossJoin(lengths(names)).select(F.explode(_parts_within(F.col("n"), F.col("lengths"))).alias("k"), "first")), "k")
    best = word.select("n", "first").unionByName(within.select("n", "first")).unionByName(around.select("n", "first")).groupBy("n").agg(F.min("first").alias("first"))
    return x.join(best, "n").select("name", "first")


def patch_affiliations(people: DataFrame) -> DataFrame:
    """``(id, affiliation)`` for ``people(id, rid, props)`` with an address but no affiliation.

    It is that of the first (by ``rid``) person without an address whose name overlaps.
    """
    has = lambda k: F.coalesce(F.col("props")[k], F.lit("")) != ""
    name = F.coalesce(F.col("props")["personName"], F.lit("")).alias("name")
    mailed = people.where(has("personEmail") & ~has("affiliation")).select("id", name)
    giving = people.where(has("affiliation") & ~has("personEmail")).select(name, F.struct("rid", "id", F.col("props")["affiliation"].alias("affiliation")).alias("first"))
    met = first_overlapping(mailed.select("name").distinct(), giving)
    # Many people may share a name; a small table of names is sent to them, so that none of its rows are gathered in one task.
    side = stage(met)
    return mailed.join(F.broadcast(side) if small_enough(side, 100_000) else side, "name").groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.affiliation").alias("affiliation"))


def with_affiliations(entities: DataFrame) -> DataFrame:
    """``entities(id, type, rid, props)`` with the affiliations that :func:`patch_affiliations` finds."""
    found = patch_affiliations(entities.where("type = 'Person'")).select(F.col("id").alias("_id"), F.map_from_arrays(F.array(F.lit("affiliation")), F.array("affiliation")).alias("_more"))
    props = F.when(F.col("_more").isNotNull(), F.map_concat(F.map_filter("props", lambda k, v: k != "affiliation"), "_more")).otherwise(F.col("props"))
    return entities.join(found, entities.id == F.col("_id"), "left").withColumn("props", props).select(*entities.columns)


def capped_pairs(pairs: DataFrame, cap: int = 3) -> DataFrame:
    """Of ``pairs(kind, i, j, score, id1, id2)`` the greedy choice in the order of ``i``: each row takes its first ``cap`` partners, best first, that no earlier row took with it.

    ``i`` is the place of a row within its kind and ``j`` that of its partner; a
    pair that both ends find is taken once. A row's choice depends on the pairs
    that earlier rows took with it and nothing else: so rounds over rows of which
    all earlier partners are settled give the sequential result. Rows settle in
    as many rounds as the longest rising chain of partners, with no task for a
    whole kind.
    """
    own = stage(pairs.select("kind", "i", "j", "score", "id1", "id2"))
    order = Window.partitionBy("kind", "i").orderBy(F.desc("score"), "j")
    settled = None
    open_ = own
    while not open_.isEmpty():
        mutual = open_.select("kind", F.col("i").alias("j"), F.col("j").alias("i")).where("j < i").join(open_.select("kind", "i", "j"), ["kind", "i", "j"], "left_semi")
        later = mutual.select("kind", "i").distinct()
        ready = open_.join(later, ["kind", "i"], "left_anti")
        if settled is not None:
            taken = settled.where("took").select("kind", F.col("i").alias("j"), F.col("j").alias("i"))
            ready = ready.join(taken, ["kind", "i", "j"], "left_anti")
        done = ready.withColumn("took", F.row_number().over(order) <= cap)
        settled = stage(done if settled is None else settled.unionByName(done))
        open_ = stage(open_.join(later, ["kind", "i"], "left_semi"))
    out = own.withColumn("took", F.lit(True)).limit(0) if settled is None else settled.where("took")
    return out.drop("took")


def named_alike(kind: Column, a: Column, b: Column, kinds: tuple[str, ...] = ("Person", "Conference", "Journal"), least: float = 0.92) -> Column:
    """Whether two labels of a kind of proper names are alike by Jaro-Winkler; labels of other kinds always are."""
    proper = kind.isin(*kinds)
    return ~proper | (jaro_winkler(F.when(proper, a), F.when(proper, b)) >= least)


def gated_pairs(rows: DataFrame, kinds: tuple[str, ...] = ("Person", "Conference", "Journal"), least: float = 0.92, block: int | None = None) -> DataFrame:
    """``(id1, id2)``, ``id1 < id2``, of rows ``(id, grp, kind, name)`` of one group, for whose names and kind of the first :func:`named_alike` holds.

    Rows without a kind are no first ones. Every pair is looked at, and most may be
    returned: a tile of two blocks of a group is a task, which yields them piece by
    piece, so memory doesn't grow with a group, and a large group is many tasks.
    """
    own = rows.where("id is not null and grp is not null").select("id", F.col("grp").alias("_k"), "kind", "name")
    kind_id = dict(rows.dtypes)["id"]

    def pairs(t: pa.Table, low: np.ndarray, high: np.ndarray) -> Iterator[pa.Table]:
        rank = t.column("id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        kind, name, ids = t.column("kind").combine_chunks(), t.column("name").combine_chunks(), t.column("id").combine_chunks()
        first = kind.is_valid().to_numpy(zero_copy_only=False)
        proper = pc.is_in(kind, pa.array(list(kinds))).to_numpy(zero_copy_only=False)
        given = name.is_valid().to_numpy(zero_copy_only=False)
        long = pc.utf8_length(name).fill_null(0).to_numpy(zero_copy_only=False) > 64

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.zeros((len(a), len(b)), bool)
            if long[a].any() or long[b].any():
                i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
                return pc.fill_null(pc.greater_equal(_jaro(name.take(pa.array(a[i])), name.take(pa.array(b[j]))), least), False).to_numpy(zero_copy_only=False).reshape(len(a), len(b))
            i, j = np.flatnonzero(given[a]), np.flatnonzero(given[b])
            out[np.ix_(i, j)] = jaro_winkler_table(name.take(pa.array(a[i])), name.take(pa.array(b[j]))) >= least
            return out

        for rows, cols in [(low, high)] if np.array_equal(low, high) else [(low, high), (high, low)]:
            for these in (rows[first[rows] & proper[rows]], rows[first[rows] & ~proper[rows]]):
                for c in range(0, len(cols), 1024):
                    q = cols[c : c + 1024]
                    for a in range(0, len(these), 64):
                        r = these[a : a + 64]
                        if rank[r[0]] >= rank[q[-1]]:
                            break
                        good = rank[r][:, None] < rank[q][None, :]
                        if proper[r[0]]:
                            good &= alike(r, q)
                        i, j = np.divmod(np.flatnonzero(good), len(q))
                        if len(i):
                            yield pa.table({"id1": ids.take(pa.array(r[i])), "id2": ids.take(pa.array(q[j]))})

    return by_tile(tiles(own, block), pairs, f"id1 {kind_id}, id2 {kind_id}")


def sample_target(n: Column) -> Column:
    """About 40 % of up to 1,000 rows, 15 % of up to 5,000 (500 at most), else 500."""
    return F.when(n < 1000, F.floor(n * 0.4)).when(n < 5000, F.least(F.lit(500), F.floor(n * 0.15))).otherwise(F.lit(500))


def stratified_sample(pairs: DataFrame, kind: str, key: list[str], seed: int = 42) -> DataFrame:
    """A sample of :func:`sample_target` rows; of each kind in proportion, one at least, then trimmed or topped up to the target.

    Rows are drawn by a seeded hash of their key, so a sample doesn't depend on
    partitions. The rank within a kind is a limit: no task holds more than it takes.
    """
    n = pairs.agg(F.count("*").alias("n"))
    share = pairs.groupBy(kind).agg(F.count("*").alias("nt")).crossJoin(n).select(F.col(kind).alias("kind_"), sample_target(F.col("n")).alias("target_"), F.greatest(F.lit(1), F.floor(sample_target(F.col("n")) * F.col("nt") / F.col("n"))).alias("take_"))
    share = stage(share)
    target = (share.first() or {"target_": 0})["target_"]
    side = F.broadcast(share) if small_enough(share, 100_000) else share
    draw = F.xxhash64(F.lit(seed), *key)
    rank = F.row_number().over(Window.partitionBy(kind).orderBy("draw_", *key))
    drawn = pairs.withColumn("draw_", draw).withColumn("rank_", rank).where(F.col("rank_") <= max(1, target))
    first = drawn.join(side, drawn[kind].eqNullSafe(F.col("kind_"))).withColumn("late_", F.col("rank_") > F.col("take_"))
    return first.orderBy("late_", "draw_", *key).limit(target).select(*pairs.columns)


def registry(mentions: DataFrame, prefixes: dict[str, str], taken: DataFrame | None = None) -> DataFrame:
    """``(type, key, id)`` of mentions ``(type, key, record, pos)``: ids number the keys of a type as they first appear, from 1 or from ``taken(type, n)`` on."""
    first = mentions.groupBy("type", "key").agg(F.min(F.struct("record", "pos")).alias("at"))
    prefix = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    ranked = numbered(first, ["at", "key"], "n", ["type"])
    if taken is not None:
        ranked = ranked.join(taken.select("type", F.col("n").alias("_before")), "type", "left").withColumn("n", F.col("n") + F.coalesce("_before", F.lit(0)))
    return ranked.select("type", "key", F.concat(F.coalesce(prefix[F.col("type")], F.lower("type")), F.col("n").cast("string")).alias("id"))


def merged_mentions(mentions: DataFrame) -> DataFrame:
    """``(type, key, props)``: each property's value in the last mention ``(record, pos)`` that has it."""
    each = mentions.select("type", "key", "record", "pos", F.explode("props").alias("k", "v"))
    last = each.groupBy("type", "key", "k").agg(F.max_by("v", F.struct("record", "pos")).alias("v"))
    return last.groupBy("type", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
