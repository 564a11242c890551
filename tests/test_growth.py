"""Steps whose work grew with pairs of rows, held against trial of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import vectors
from quillgraph.operators import evaluation as ev
from quillgraph.operators import resolution as er
from quillgraph.operators import tiles
from quillgraph.operators import triples as tr


def test_first_overlapping_name_without_pairs(spark):
    rng = random.Random(5)
    words = ["anna", "li", "hanna", "an", "prof.", "office", "Editorial", "berg", "bergman", "o", "Li", "lisa", "", " Anna"]
    names = lambda n: [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(n)]
    a, b = spark.createDataFrame(names(80), "id int, name string"), spark.createDataFrame(names(80), "id int, name string")
    met = er.overlapping_names(a, b).join(a, F.col("id1") == a.id).groupBy("name").agg(F.min("id2").alias("first"))
    got = er.first_overlapping(a, b.select("name", F.col("id").alias("first")).union(spark.createDataFrame([(None, 0)], "name string, first int")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in met.collect()} and got.count() > 40
    assert er.first_overlapping(a, b.limit(0).toDF("first", "name")).count() == 0
    # 10,000 people of one name met 10,000 others in 10^8 pairs.
    people = spark.range(20_000).select(F.col("id"), F.col("id").alias("rid"), F.map_from_arrays(F.array(F.lit("personName"), F.expr("if(id % 2 = 0, 'personEmail', 'affiliation')")), F.array(F.lit("Ann Lee"), F.concat(F.lit("x"), "id"))).alias("props"))
    found = er.patch_affiliations(people)
    assert "NestedLoop" not in found._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in found.groupBy("affiliation").count().collect()] == [("x1", 10_000)]


def vectors_with_ties(n=90, seed=6):
    """Rows ``(id, kind, vec)`` with null kinds, a null vector, equal and zero vectors."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), None if i % 11 == 0 else "ab"[i % 2], [float(v) for v in np.round(rng.normal(size=4) / 2, 1)]) for i in rng.permutation(n)]
    return rows[:-2] + [(1000, "a", [0.0] * 4), (1001, "b", list(rows[0][2]))]


def score(v, w, clamped=True):
    s = round(float(np.dot(v, w)), 6)
    return min(1.0, max(0.0, s)) if clamped else s


@pytest.mark.parametrize("block", [7, 40, None])
def test_best_partners_as_of_all_pairs(spark, block):
    rows = vectors_with_ties()
    df = spark.createDataFrame(rows, "id int, kind string, vec array<float>")
    rows = [(i, k, np.asarray(v, np.float32).astype(float)) for i, k, v in rows]

    def best(k, fits, clamped):
        return {(i, j, s, r + 1) for i, kind, v in rows for r, (s, j) in enumerate(sorted(((score(v, w, clamped), j) for j, other, w in rows if fits(i, kind, j, other) and (clamped or score(v, w, clamped) > 0.1)), key=lambda x: (-x[0], x[1]))[:k])}

    got = tiles.best_partners(df, 3, kinds=False, later=True, clamped=True, block=block)
    assert {(r["id"], r["other"], r["score"], r["rank"]) for r in got.collect()} == best(3, lambda i, a, j, b: i < j, True)
    got = tiles.best_partners(df, 3, 0.1, block=block)
    assert {(r["id"], r["other"], r["score"], r["rank"]) for r in got.collect()} == best(3, lambda i, a, j, b: i != j and a == b, False)
    assert tiles.best_partners(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("block", [7, None])
def test_score_classes_as_of_all_pairs(spark, block):
    rows = vectors_with_ties()
    df = spark.createDataFrame([*rows, rows[3]], "id int, kind string, vec array<double>").union(spark.createDataFrame([(2000, "a", None)], "id int, kind string, vec array<double>"))
    rows = [*rows, rows[3], (2000, "a", [0.0] * 4)]
    want = {}
    for i, a, v in rows:
        for j, b, w in rows:
            if i < j:
                key = (None if a is None or b is None else a == b, int(score(v, w) * 10 + 1e-9))
                want[key] = want.get(key, 0) + 1
    steps = lambda s: np.floor(s * 10 + 1e-9)
    assert {(r["same"], r["class"]): r["n"] for r in tiles.score_classes(df, steps, block=block).collect()} == want
    alike = {c: n for (same, c), n in want.items() if same}
    assert {r["class"]: r["n"] for r in tiles.score_classes(df.where("kind is not null"), steps, kinds=True, block=block).collect()} == alike
    assert ev.pairs_of_a_kind(df).first()["total"] == sum(alike.values())
    counts = {r["point"]: (r["predicted"], r["tp"], r["actual"]) for r in er.pair_sweep(df, 11).collect()}
    assert counts[0] == (sum(want.values()), sum(alike.values()), sum(alike.values())) and counts[10] == (sum(n for (_, c), n in want.items() if c == 10), alike[10], sum(alike.values()))


@pytest.mark.parametrize("name", ["recall_at_k", "threshold_sweep", "prf", "greedy_pairs", "thresholds", "blocking_topk"])
def test_no_query_lists_all_pairs(spark, monkeypatch, name):
    from quillgraph.plans import catalogue
    from tests.conftest import SF

    def listed(*args, **kwargs):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(er, "_block_products", listed)
    assert catalogue.queries()[name](spark, SF).columns


def test_a_mail_is_made_a_cell_once(spark):
    relations = spark.createDataFrame([(i, "p", "s", "r", 'say "x"\n', f"m{i % 3}" if i % 4 else "header") for i in range(40)], "rid int, start string, end string, relation string, context string, source string")
    entities = spark.createDataFrame([("p", "Paper", {"paperTitle": "P"}, 1), ("s", "Person", {"personName": "S"}, 1)], "id string, type string, props map<string,string>, rid int")
    mails = spark.createDataFrame([("m0", 'a "b"\nc'), ("m0", "z"), ("m1", None), ("m9", "x")], "source string, text string")
    got = tr.annotation_sample(relations, entities, mails, n=5)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {0: "a 'b' [NEWLINE] c", 1: ""}
    assert sorted(tuple(r) for r in got.collect()) == sorted(("P", "r", "S", "say 'x' ", want[i % 3], f"m{i % 3}") for i in range(40) if i % 4 and i % 3 < 2)


def test_jaro_winkler_of_blocks():
    rng = random.Random(4)
    for head in ("", "Customer#0"):
        texts = [head + t for t in ["", "a", "martha", "marhta", "dixon", "dicksonx", "日本語", "日語本", "x" * 50] + ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(60)]]
        got = vectors.jaro_winkler_table(pa.array(texts), pa.array(texts[::-1]))
        want = [[vectors.jaro_winkler_of(a, b) for b in texts[::-1]] for a in texts]
        assert np.abs(got - np.array(want)).max() < 1e-12


@pytest.mark.parametrize("block", [5, None])
def test_gated_pairs_as_of_a_join(spark, block):
    rng = random.Random(8)
    rows = [(rng.randrange(200), rng.choice(["g", "h", None]), rng.choice(["Person", "Task", None]), rng.choice(["martha", "marhta", "marta", "x" * 70, "x" * 69 + "y", "", None])) for _ in range(90)]
    df = spark.createDataFrame(rows, "id int, grp string, kind string, name string")

    def alike(kind, a, b):
        return kind == "Task" or kind == "Person" and a is not None and b is not None and vectors.jaro_winkler_of(a, b) >= 0.92

    want = sorted((i, j) for i, g, k, a in rows for j, h, _, b in rows if g is not None and g == h and i < j and alike(k, a, b))
    assert sorted(tuple(r) for r in er.gated_pairs(df, block=block).collect()) == want and len(want) > 300


def test_assignment_without_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    for shape in ((3, 3), (40, 50), (50, 40), (120, 121), (1, 9), (0, 4), (300, 310)):
        x, y = rng.normal(size=(shape[0], 6)), rng.normal(size=(shape[1], 6))
        assert ev.best_partners_of(x, y, 0) == ev.best_assignment(x @ y.T)
    same = np.ones((30, 2))
    assert sorted(i for i, _ in ev.best_partners_of(same, same, 0)) == list(range(30))


def test_assignment_takes_memory_by_rows():
    import tracemalloc

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(6000, 24)), rng.normal(size=(6100, 24))
    tracemalloc.start()
    assert len(ev.best_partners_of(x, y)) == 6000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6100 * 8 * 0.75
