import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.functions import answers, dates, text, vectors
from quillgraph.operators import entity_dates, evaluation, extraction, triples
from quillgraph.operators import graph as g
from quillgraph.operators import resolution as er
from quillgraph.plans.starschema import ONTOLOGY
from quillgraph.sources import corpus
from quillgraph.streaming.append import append_stream


def test_numbers_of_a_million_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(1_000_000).select(F.xxhash64("id").alias("k"), F.repeat(F.col("id").cast("string"), 8).alias("payload"), (F.col("id") % 3).alias("w"))
        n = corpus.numbered(rows, ["k"], "n").agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.countDistinct("payload")).first()
        assert tuple(n) == (1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
        per = corpus.numbered(rows.withColumn("w", F.when(F.col("w") > 0, F.col("w"))), ["k"], "n", ["w"]).groupBy("w").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m")).collect()
        assert len(per) == 3 and all(r["c"] == r["d"] == r["m"] for r in per)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1), (None, 0), ("c", 3)], "k string, v int")
    assert [(r["v"], r["n"]) for r in corpus.numbered(rows, ["v"], "n").orderBy("n").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert corpus.numbered(rows.limit(0), ["v"], "n").count() == 0


@pytest.mark.parametrize(
    "given, entities, relations",
    [
        ('```json\n{"entities": [{"id": "a", "type": "T", "properties": {"x": 1, "y": null, "z": {"q": 2}}}]}\n```', [("a", "T")], []),
        ('[{"entities": [{"id": "a", "type": "T"}]}, {"relations": [{"source": "a", "target": "b", "type": "r", "evidence": "e"}]}]', [("a", "T")], [("a", "b", "r", "e")]),
        ('{"entities": [{"id": "none", "type": "T"}, {"id": " ", "type": "T"}, {"id": 7, "type": "N"}], "relations": [{"start": "a"}, 5]}', [("7", "N")], []),
        ('{"entities": [{"id": "a", "type": "T"}], "relations": [{"start_id": "a", "end_id": "b", "relation": "r"}]', [("a", "T")], [("a", "b", "r", "")]),
        ('noise {"id": "a", "type": "T", "properties": {"k": "v"}} [{"start_id": "a", "end_id": "b", "relation": "r", "context": "c"}] {"x": {', [("a", "T")], [("a", "b", "r", "c")]),
        ("garbage", [], []),
        ("", [], []),
        (None, [], []),
    ],
)
def test_model_answers(spark, given, entities, relations):
    r = spark.createDataFrame([(given,)], "answer string").select(answers.graph_answer(F.col("answer")).alias("g")).first()["g"]
    assert [(e["id"], e["type"]) for e in r["entities"]] == entities and [tuple(x) for x in r["relations"]] == relations
    if entities == [("a", "T")] and "null" in given:
        assert {k: v for k, v in r["entities"][0]["properties"].items() if v is not None} == {"x": "1", "z": '{"q": 2}'}


def test_greedy_cap_is_the_sequential_one(spark):
    rng = random.Random(5)
    n, cap = 60, 3
    partners = {(k, i): sorted(((round(rng.random(), 2), j) for j in rng.sample(range(n), 9) if j != i), key=lambda x: (-x[0], x[1])) for k in "ab" for i in range(n)}
    want, seen = set(), set()
    for k in "ab":
        for i in range(n):
            took = 0
            for _, j in partners[k, i]:
                if took < cap and (k, min(i, j), max(i, j)) not in seen:
                    seen.add((k, min(i, j), max(i, j)))
                    want.add((k, i, j))
                    took += 1
    rows = [(k, i, j, s, f"x{i}", f"x{j}") for (k, i), own in partners.items() for s, j in own]
    got = er.capped_pairs(spark.createDataFrame(rows, "kind string, i int, j int, score double, id1 string, id2 string"), cap).collect()
    assert {(r["kind"], r["i"], r["j"]) for r in got} == want and len(got) == len(want)
    assert er.capped_pairs(spark.createDataFrame([], "kind string, i int, j int, score double, id1 string, id2 string")).count() == 0


def test_names_meet_by_keys_as_by_trial(spark):
    rng = random.Random(3)
    words = ["anna", "li", "hanna", "an", "prof.", "office", "Editorial", "berg", "bergman", "o", "Li", "lisa", ""]
    names = lambda n: [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(n)]
    a, b = spark.createDataFrame(names(80), "id int, name string"), spark.createDataFrame(names(80), "id int, name string")
    pairs = lambda small: {tuple(r) for r in er.overlapping_names(a, b, small).collect()}
    assert pairs(0) == pairs(1000) and len(pairs(0)) > 500


def test_blocks_of_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "k" if i % 3 else None, [float(v) for v in rng.normal(size=5)]) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, kind string, vec array<double>")
    want = {(k, i, j) for i, k, v in rows for j, m, w in rows if i < j and k == m and round(float(np.dot(v, w)), 6) > 1.0}
    assert {(r["kind"], r["id1"], r["id2"]) for r in er.similar_pairs(df, 1.0, block=8).collect()} == want and len(want) > 100
    assert er.all_pairs(df, block=16).count() == 70 * 69 // 2 and er.all_pairs(df.limit(0)).count() == 0


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(4)
    texts = ["", "a", "martha", "marhta", "dixon", "dicksonx", "日本語", "日語本", "x" * 200, "x" * 199 + "y"] + ["".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 30)] + [(None, "a"), ("a", None)]
    got = vectors._jaro(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).to_pylist()
    assert all(g == pytest.approx(vectors.jaro_winkler_of(a, b), abs=1e-12) if g is not None else a is None or b is None for g, (a, b) in zip(got, pairs))


def test_text_moves_in_time(spark):
    d = lambda s: datetime.strptime(s, "%Y-%m-%d")
    move = lambda t, compat=False: spark.createDataFrame([(t,)], "t string").select(dates.moved_text(F.col("t"), d("2010-01-01"), d("2020-01-01"), d("2020-01-01"), d("2030-01-01"), compat)).first()[0]
    assert move("On 01-01-2010, 1st March 2015 and Jan 2nd, 2012 (2013) x20151 1999") == "On 01-01-2020, 28th February 2025 and January 1st, 2022 (2023) x20151 1999"
    assert move("01-01-2010", compat=True) == "01-01-2030" and move(None) is None and move("") == "" and move("32-01-2010") == "32-01-2010"


def test_threads(spark):
    rows = [(1, "Re: Plan"), (2, "plan"), (3, ""), (4, None), (5, "FW: other")]
    got = {r["record"]: r["thread"] for r in entity_dates.regrouped_threads(spark.createDataFrame(rows, "record int, subject string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4 and all(len(t) == 6 for t in got.values())


def test_extraction_from_headers_to_report(spark):
    mail = "Thread ID: THR-1\nMail ID: MAIL-1\nDate: 5-6-2019\nFrom: Ann <a@b.c>\nTo: a@b.c, Bob\nSubject: Hi\n\nbody"
    m = extraction.with_ids(extraction.header_mentions(spark.createDataFrame([(1, mail), (2, mail.replace("MAIL-1", "MAIL-2")), (3, "no headers")], "record int, text string"))).cache()
    once = extraction.once_per_record(m)
    assert sorted((r["record"], r["id"]) for r in once.collect()) == sorted((k, i) for k, e in ((1, "em1"), (2, "em2")) for i in (e, "th1", "me1", "me2"))
    rel = extraction.header_relations(m)
    assert {(r["start_id"], r["end_id"], r["relation"]) for r in rel.where("record = 2").collect()} == {("em2", "th1", "partOf"), ("em2", "me1", "sentBy"), ("em2", "me1", "receivedBy"), ("em2", "me2", "receivedBy")}
    report = {(r["part"], r["origin"], r["kind"]): r["n"] for r in extraction.extraction_report(extraction.last_rows(once), rel).collect()}
    assert report["entities", "Regex", "Person"] == 2 and report["relations by origin", "Regex", None] == rel.count()


def test_alignment_of_entities(spark):
    schema = "email_id string, subject_label string, subject_type string, object_label string, object_type string, evidence_sentence string"
    gold = spark.createDataFrame([("e1", "Deep Nets", "Method", "Birds", "Dataset", "x"), ("e1", "deep nets", "Method", None, "Dataset", "y"), ("e2", "only", "Task", "gold", "Task", "")], schema)
    pred = spark.createDataFrame([("e1", "the deep nets", "Method", "Birds", "Dataset", "x"), ("e3", "a", "Task", "b", "Task", "")], schema)
    got = {(r["email_id"], r["gold_id"], r["pred_id"]) for r in triples.aligned_entities(gold, pred, providers.hashed_vector).collect()}
    assert got == {("e1", "deep nets\x1fMethod", "the deep nets\x1fMethod"), ("e1", "birds\x1fDataset", "birds\x1fDataset")}
    assert triples.report_lines(evaluation.accuracy(spark.createDataFrame([("a", True)], "k string, ok boolean"), "k", "ok"), 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"\ny'), ("b", ""), ("c", None)], "k string, v string")
    corpus.write_csv(df, str(tmp_path / "t"), 1)
    corpus.write_csv(df, str(tmp_path / "t"), 1)
    assert {r["k"]: r["v"] for r in corpus.read_csv(spark, str(tmp_path / "t"), "k string, v string").collect()} == {"a": 'x "q"\ny', "b": None, "c": None}
    assert {(r["k"], r["file"][:4]) for r in corpus.read_parts(spark, str(tmp_path / "t"), "k string, v string").collect()} == {("a", "part"), ("b", "part"), ("c", "part")}
    corpus.write_by_type(df, str(tmp_path / "p"), "k")
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["k=a", "k=b", "k=c"]
    df.write.parquet(str(tmp_path / "w"))
    assert corpus.wipe_tables(spark, [str(tmp_path / "w")]) == {str(tmp_path / "w"): 3} and spark.read.parquet(str(tmp_path / "w")).count() == 3
    corpus.wipe_tables(spark, [str(tmp_path / "w")], dry_run=False)
    left = spark.read.parquet(str(tmp_path / "w"))
    assert left.count() == 0 and left.columns == ["k", "v"]
    (tmp_path / "prompt.txt").write_text("Do it.")
    assert corpus.read_text(str(tmp_path / "prompt.txt")) == "Do it."
    (tmp_path / "o.json").write_text('{"nodes": {"A": {"properties": ["x"]}, "B": {}}, "relationships": {"r": {"type": "rel", "valid_pairs": [["A", "B"]]}}}')
    o = corpus.Ontology.load(str(tmp_path / "o.json"))
    assert o.nodes == {"A": ["x"], "B": []} and o.relations == {"rel": [("A", "B")]} and o.paths() == ["(:A)-[:rel]->(:B)"]


def test_stream_appends_each_key_once(spark, tmp_path):
    for part in (range(5), range(3, 9)):
        spark.range(part.start, part.stop).selectExpr("cast(id as string) key").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
        append_stream(source, lambda d: d.withColumn("n", F.length("key")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [str(i) for i in range(9)]


def test_last_type_decides(spark):
    o = corpus.Ontology({"A": [], "B": []}, {"r": [("A", "B")]})
    e = spark.createDataFrame([("x", "B", 1), ("x", "A", 2), ("y", "B", 1)], "id string, type string, rid int")
    rel = spark.createDataFrame([("x", "r", "y")], "start string, relation string, end string")
    assert g.clean_edges(rel, e, o).count() == 1


def test_questions(spark):
    ok = g.Pattern(g.Node("n", "Nation", ("name",)))
    tries = []

    def generate(question, problems):
        tries.append(list(problems))
        return ok if len(tries) > 1 else g.Pattern(g.Node("n", "Email"))

    rows = spark.createDataFrame([("Nation", "n1", {"name": "PERU"})], "label string, id string, props map<string,string>")
    run = lambda p: p.match(rows, None)
    check = lambda p: p.problems(ONTOLOGY)
    assert providers.answered("?", generate, check, run) == '[{"n_id":"n1","n_name":"PERU"}]' and tries[1]
    assert providers.answered("?", lambda q, p: g.Pattern(g.Node("n", "Email")), check, run) == "could not be extracted"
    assert providers.answered("?", lambda q, p: ok, check, lambda p: 1 / 0).startswith("error")
    assert "Paths" in providers.question_prompt("q", "s", ONTOLOGY.paths(), ["wrong"])
    spans = providers.extraction_prompts(spark.createDataFrame([(1, "hi")], "record int, body string"), spark.createDataFrame([], "record int, pos int, id string, type string, props map<string,string>"), "Do.")
    assert spans.first()["prompt"] == "Do.\n\nNo persons in headers.\n\nhi"
    said = providers.Batched(lambda: lambda prompts: [p.upper() for p in prompts]).answers(spark.createDataFrame([(1, "a")], "key int, prompt string"))
    assert said.first()["answer"] == "A"
    judged = spark.createDataFrame([(0.9, "Ann Lee", "Ann Lee"), (0.9, "Ann", "Bob"), (0.1, "Ann", "Ann")], "s double, a string, b string").select(providers.rule_judge(F.col("s"), F.col("a"), F.col("b")).alias("v"))
    assert [r["v"] for r in judged.collect()] == ["MATCH", "NO_MATCH", "NO_MATCH"]


def test_sample_reaches_its_target(spark):
    rows = spark.createDataFrame([("a" if i < 700 else f"k{i % 30}", i) for i in range(900)], "kind string, id int")
    got = er.stratified_sample(rows, "kind", ["id"]).collect()
    per = defaultdict(int)
    for r in got:
        per[r["kind"]] += 1
    assert len(got) == 360 and len({r["id"] for r in got}) == 360 and 250 <= per["a"] <= 300


def test_blocking_text(spark):
    row = spark.createDataFrame([({"personName": None},), ({"x": "1"},)], "p map<string,string>").select(text.blocking_label(F.col("p")).alias("l")).collect()
    assert [r["l"] for r in row] == ["None", None]
