import numpy as np
import pytest
from itertools import permutations

from pyspark.sql import functions as F

from quillgraph.functions import dates, text, vectors
from quillgraph.operators import evaluation as ev
from quillgraph.operators import graph as g
from quillgraph.operators import resolution as er
from quillgraph.operators.components import connected_components
from quillgraph.plans import catalogue
from quillgraph.plans.starschema import ONTOLOGY
from quillgraph.sources import corpus
from tests.conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, sql, name):
    assert same(catalogue.queries()[name](spark, SF).collect(), sql(catalogue.oracle_sql()[name]))


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "given, want",
    [("15 June 2023", "2023-06-15"), ("15th June 2023", "2023-06-15"), ("2019-04-08", "2019-04-08"), ("2019-4", "2019-04-01"), ("3/5/2019", "2019-05-03"), ("April 5th, 2019", "2019-04-05"), ("Friday, 5 April", "2019-04-05"), ("March 2019", "2019-03-01"), ("Sept 5", "2019-09-05"), ("31 February 2020", "31 February 2020"), ("2022", "2022-01-01"), ("TBD", "TBD"), ("maybe", "maybe"), ("marketing", "marketing"), ("2019 march", "2019-03-01"), (None, None)],
)
def test_dates(spark, given, want):
    assert column(spark, given, dates.normalize_date) == want


def test_styles(spark):
    day = F.to_date(F.lit("2023-06-03"))
    assert [spark.range(1).select(dates.like_style(day, F.lit(s))).first()[0] for s in ("1-2-2020", "May 1, 2020", "1 May 2020")] == ["03-06-2023", "June 3rd, 2023", "3rd June 2023"]


def test_addresses(spark):
    got = column(spark, 'Ann B <a@b.org>; "C" [c@d.org], E (e@f.org), G H (Some Lab), i@j.org, K', text.addresses)
    assert [tuple(r) for r in got] == [("Ann B", "a@b.org", None), ("C", "c@d.org", None), ("E", "e@f.org", None), ("G H", None, "Some Lab"), (None, "i@j.org", None), ("K", None, None)]


def test_message(spark):
    m = "Update: no\nThread ID: THR-A7B3K9\nFrom: A\n B <a@b.c>\nSubject: FW: Re:  the  Plan\n\nHello\nthere\n"
    h = column(spark, m, text.headers)
    assert (h["thread_id"], h["sender"], h["date"], h["cc"]) == ("THR-A7B3K9", "A B <a@b.c>", None, None)
    assert column(spark, m, text.body) == "Hello\nthere"
    assert column(spark, h["subject"], text.thread_subject) == "the plan"
    assert [column(spark, x, text.verdict) for x in ("Match", "NO MATCH", "no_match")] == ["MATCH", "NO_MATCH", "NO_MATCH"]
    assert column(spark, "NO MATCH", lambda c: text.verdict(c, compat=True)) == "MATCH"


def test_components(spark):
    pairs = [("me10", "me2"), ("me2", "me3"), ("a", "b"), ("b", "c"), ("c", "a"), ("z", "z"), (None, "q")] + [(f"s{i}", f"s{i + 1}") for i in range(10, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got["me2"] == got["me3"] == got["me10"] == "me10" and got["c"] == "a" and got["z"] == "z" and "q" not in got and got["s60"] == "s10"


def test_upserts(spark):
    nodes = spark.createDataFrame([("P", "1"), ("P", "2")], "label string, id string")
    rows = spark.createDataFrame([("1", "t", "2", 1, "old"), ("1", "t", "2", 2, "new"), ("1", "t", "2", 3, None), ("1", "t", "9", 4, "x")], "start string, type string, end string, rid int, context string")
    assert [tuple(r) for r in g.upsert_edges(rows, nodes, "rid", ["context"]).collect()] == [("1", "t", "2", "new")]


def test_validator():
    ok = g.Pattern(g.Node("c", "Customer"), (g.Hop(("inNation",), g.Node("n", "Nation")), g.Hop(("inRegion",), g.Node("r", "Region"))))
    assert ok.problems(ONTOLOGY) == []
    assert g.Pattern(g.Node("n", "Nation"), (g.Hop(("inNation",), g.Node("c", "Customer")),)).problems(ONTOLOGY)
    assert not g.Pattern(g.Node("n", "Nation"), (g.Hop(("inNation",), g.Node("c", "Customer"), "-"),)).problems(ONTOLOGY)
    second = g.Pattern(g.Node("c", "Customer"), (g.Hop(("inNation",), g.Node("n", "Nation")), g.Hop(("placed", "inRegion"), g.Node("r", "Region"))))
    assert len(second.problems(ONTOLOGY)) == 1
    assert g.Pattern(g.Node("x", "Email")).problems(ONTOLOGY) and g.Pattern(g.Node("p", "Part", ("size",))).problems(ONTOLOGY)
    assert g.Pattern(g.Node("p", "Part"), forbidden=frozenset({"Part"})).problems(ONTOLOGY)


def test_fusion(spark):
    canon = spark.createDataFrame([("b", "a"), ("a", "a")], "node string, component string")
    e = spark.createDataFrame([(1, "a", "b", "r", "c"), (2, "b", "x", "r", "c"), (3, "a", "x", "r", "c"), (4, None, "x", "r", "c")], "rid int, start string, end string, relation string, context string")
    assert sorted((r["rid"], r["start"]) for r in er.remap_edges(e, canon).collect()) == [(2, "a"), (4, None)]
    p = spark.createDataFrame([("a", {"k": "own"}), ("b", {"k": "x", "m": "more"}), ("z", {})], "id string, props map<string,string>")
    assert {r["id"]: r["props"] for r in er.merge_properties(p, canon).collect()} == {"a": {"k": "own", "m": "more"}, "z": {}}


def test_assignment():
    rng = np.random.default_rng(1)
    for shape in [(3, 3), (2, 5), (5, 2), (4, 6), (1, 1)]:
        for _ in range(20):
            x = rng.normal(size=shape)
            got = ev.best_assignment(x)
            big, small = max(shape), min(shape)
            y = x if shape[0] <= shape[1] else x.T
            best = max(sum(y[i, p[i]] for i in range(small)) for p in permutations(range(big), small))
            assert len(got) == small and abs(sum(x[i, j] for i, j in got) - best) < 1e-9
    assert ev.best_assignment(np.zeros((0, 3))) == []


def test_scores_without_rows(spark):
    none = spark.createDataFrame([], "truth boolean, predicted boolean")
    assert ev.prf(none, 1.0).first()["precision"] == 1.0 and ev.prf(none).first()["recall"] == 0.0
    assert vectors.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)


def test_records(spark, tmp_path):
    (tmp_path / "mail.txt").write_text("one\nEMAIL_END  \nEMAIL_ENDtwo EMAIL_END three")
    assert [tuple(r) for r in corpus.read_records(spark, str(tmp_path)).orderBy("record").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    whole = spark.createDataFrame([("Thread ID: 1\nx\nEMAIL_ENDThread ID: 2\ny",)], "t string")
    assert len(whole.select(corpus.split_at_headers(F.col("t"))).first()[0]) == 2


def test_csv_and_stream(spark, tmp_path):
    from quillgraph.streaming.append import append_stream

    (tmp_path / "a.csv").write_text('id,v\n1,"x ""q""\ny"\n2,NA\n3,\n')
    assert [r["v"] for r in corpus.read_csv(spark, str(tmp_path / "a.csv"), "id string, v string").orderBy("id").collect()] == ['x "q"\ny', None, None]
    assert [r["v"] for r in corpus.read_csv(spark, str(tmp_path / "a.csv"), "id string, v string", infer_nulls=False).orderBy("id").collect()][1:] == ["NA", ""]
    spark.range(5).selectExpr("cast(id as string) key").write.parquet(str(tmp_path / "in"))
    q = append_stream(spark.readStream.schema("key string").parquet(str(tmp_path / "in")), lambda d: d.withColumn("n", F.length("key")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
