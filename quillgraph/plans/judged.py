"""Registered queries on judged pairs and on triples against a gold set, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot
from quillgraph.operators import evaluation as ev
from quillgraph.operators import resolution as er
from quillgraph.operators import triples as tr
from quillgraph.operators.tiles import best_partners
from quillgraph.plans.registered import query
from quillgraph.plans.starschema import table
from quillgraph.sources.corpus import Ontology


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotated, judged and candidate pairs of an order's parts, with repeated keys, odd labels and missing texts."""
    line = table(spark, d, "lineitem").withColumn("rid", F.expr("l_orderkey * 8 + l_linenumber"))
    keys = [F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("entity_label_1"), F.expr("case when l_linenumber = 1 then null else concat(' e', l_linenumber, ' ') end").alias("evidence_1"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("entity_label_2"), F.col("l_returnflag").alias("evidence_2")]
    few = line.where("l_orderkey % 50 = 0")
    golden = few.where("l_linenumber < 4").select("rid", *keys, F.expr("case l_orderkey % 3 when 0 then ' match' when 1 then 'NO_MATCH' else 'unsure' end").alias("label"))
    resolved = few.where("l_quantity < 40").select(*keys, F.when(F.col("l_quantity") > 20, "MATCH").otherwise("NO_MATCH").alias("llm_prediction"))
    return golden, resolved, few.select("rid", *keys, (F.col("l_quantity") / 64).alias("similarity_score"))


_KEYS = "entity_label_1, evidence_1, entity_label_2, evidence_2"
_JUDGED = f"""l AS (SELECT l_orderkey * 8 + l_linenumber AS rid, 'p' || (l_partkey % 40) AS entity_label_1, CASE WHEN l_linenumber = 1 THEN 'nan' ELSE 'e' || l_linenumber END AS evidence_1, 's' || (l_suppkey % 5) AS entity_label_2, l_returnflag AS evidence_2, * FROM lineitem WHERE l_orderkey % 50 = 0),
    g AS (SELECT rid, {_KEYS}, CASE l_orderkey % 3 WHEN 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS label FROM l WHERE l_linenumber < 4 AND l_orderkey % 3 < 2), s AS (SELECT {_KEYS}, CASE WHEN l_quantity > 20 THEN 'MATCH' ELSE 'NO_MATCH' END AS llm_prediction FROM l WHERE l_quantity < 40),
    k AS (SELECT {_KEYS}, row_number() OVER (PARTITION BY entity_label_1 ORDER BY l_quantity DESC, rid) AS rank FROM l), b AS (SELECT {_KEYS}, min(rank) AS rank FROM k GROUP BY ALL), j AS (SELECT g.*, s.llm_prediction, b.rank FROM g JOIN s USING ({_KEYS}) LEFT JOIN b USING ({_KEYS}))"""


@query(f"WITH {_JUDGED}, c AS (SELECT count(*) FILTER (label = 'MATCH' AND llm_prediction = 'MATCH') AS tp, count(*) FILTER (label <> 'MATCH' AND llm_prediction = 'MATCH') AS fp, count(*) FILTER (label = 'MATCH' AND llm_prediction <> 'MATCH') AS fn FROM j) SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c")
def er_eval(spark: SparkSession, d: str) -> DataFrame:
    """Scores of judged pairs against annotated ones."""
    return tr.judged_scores(tr.judged_pairs(*_pairs(spark, d)))


@query(f"WITH {_JUDGED}, t AS (SELECT k::INT AS k, (SELECT count(*) FROM j WHERE label = 'MATCH' AND rank <= k) / (SELECT count(*) FROM j WHERE label = 'MATCH')::DOUBLE AS recall FROM (SELECT unnest(range(1, 11)) AS k)) SELECT * FROM t WHERE k <= coalesce((SELECT min(k) FROM t WHERE recall >= 1), 10)")
def er_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the true pairs among the first k candidates of their label."""
    return ev.recall_at(tr.judged_pairs(*_pairs(spark, d)).select((F.col("label") == "MATCH").alias("truth"), "rank"))


@query(f"WITH {_JUDGED} SELECT rid, {_KEYS}, label, llm_prediction, rank::INT AS rank FROM j WHERE label <> llm_prediction")
def er_errors(spark: SparkSession, d: str) -> DataFrame:
    return tr.misjudged(tr.judged_pairs(*_pairs(spark, d))).select("rid", *tr.PAIR_KEYS, "label", "llm_prediction", "rank")


@query(f"WITH {_JUDGED} SELECT rid, 'Entity 1: ' || entity_label_1 || ' | Context: ' || evidence_1 || chr(10) || 'Entity 2: ' || entity_label_2 || ' | Context: ' || evidence_2 || chr(10) || 'Output:' AS prompt FROM l")
def pair_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)[2].select("rid", tr.pair_prompt().alias("prompt"))


@query("SELECT * FROM (VALUES ('MATCH', 3), ('NO_MATCH', 3)) t(label, n)")
def few_shots(spark: SparkSession, d: str) -> DataFrame:
    """How many examples of each label a prompt gets."""
    gold = _pairs(spark, d)[0].withColumn("label", F.upper(F.trim("label")))
    return tr.shot_lines(gold).select(F.regexp_extract("text", r"Output: (\w+)", 1).alias("label")).groupBy("label").agg(F.count("*").cast("int").alias("n"))


@query("""WITH s AS (SELECT score, truth FROM (SELECT least(1.0, greatest(0.0, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6))) AS score, a.label = b.label AND score > 0.1 AS truth FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)), q AS (SELECT unnest(range(1000)) / 999.0::DOUBLE AS t),
    c AS (SELECT t, (SELECT count(*) FROM s WHERE truth AND score + 1e-12 >= t) AS tp, (SELECT count(*) FROM s WHERE score + 1e-12 >= t) AS n FROM q), r AS (SELECT t, CASE WHEN n > 0 THEN tp / n::DOUBLE ELSE 1 END AS p, tp / (SELECT count(*) FROM s WHERE truth)::DOUBLE AS r FROM c)
    SELECT (SELECT min(t) FROM r WHERE p >= 0.98 AND r > 0) AS auto_match, (SELECT max(t) FROM r WHERE r >= 0.99) AS auto_reject""")
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The least threshold above which all is a match, and the greatest below which all is none."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("vec"))
    return er.thresholds(er.kind_sweep(v.where("kind is not null"), 0.1))


_TYPED = "SELECT l_orderkey * 8 + l_linenumber AS rid, 'p' || l_partkey AS start, 's' || l_suppkey AS \"end\", l_returnflag AS relation, l_linestatus AS context, CASE WHEN l_linenumber = 1 THEN 'header' ELSE 'MAIL-' || (l_orderkey % 100) END AS source FROM lineitem"


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Relations with their mails, and parts and some suppliers as entities, of which some are stated twice."""
    p, s = table(spark, d, "part"), table(spark, d, "supplier").where("s_suppkey % 4 > 0")
    rows = table(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("rid"), F.concat(F.lit("p"), "l_partkey").alias("start"), F.concat(F.lit("s"), "l_suppkey").alias("end"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("context"), F.expr("case when l_linenumber = 1 then 'header' else concat('MAIL-', l_orderkey % 100) end").alias("source"))
    named = lambda key: F.create_map(F.lit(key), F.col("name"))
    parts = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Paper").alias("type"), F.col("p_name").alias("name"), F.lit(1).alias("rid")).withColumn("props", named("paperTitle"))
    again = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Task").alias("type"), F.col("p_brand").alias("name"), F.lit(2).alias("rid")).withColumn("props", named("taskName"))
    people = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Person").alias("type"), F.col("s_name").alias("name"), F.lit(1).alias("rid")).withColumn("props", named("personName"))
    return rows, parts.unionByName(again).unionByName(people)


_NAMED = "n AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN 'Task' ELSE 'Paper' END AS type FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'Person' FROM supplier WHERE s_suppkey % 4 > 0)"


@query(f"WITH r AS ({_TYPED}), {_NAMED} SELECT 'e' || substr(source, 6) AS email_id, s.label AS subject_label, relation AS predicate, o.label AS object_label, context AS evidence_sentence, s.type AS subject_type, o.type AS object_type, 'model' AS source_type FROM r JOIN n s ON s.id = r.start JOIN n o ON o.id = r.end WHERE source IN ('MAIL-7', 'MAIL-40')")
def comparison_triples(spark: SparkSession, d: str) -> DataFrame:
    """Relations of some mails as triples of labels."""
    wanted = spark.createDataFrame([("e7",), ("e40",), ("e999",)], "email_id string")
    return tr.comparison_triples(*_typed(spark, d), wanted, "model")


@query(f"WITH r AS ({_TYPED}), {_NAMED} SELECT s.label AS subject, relation AS predicate, o.label AS object, context AS evidence_sentence, 'say ''hi'' [NEWLINE] ' || left(repeat(source, 300), 981) AS full_email_context, source AS original_source_id FROM r JOIN n s ON s.id = r.start JOIN n o ON o.id = r.end WHERE source <> 'header'")
def annotation_sample(spark: SparkSession, d: str) -> DataFrame:
    """Triples for annotators with their mails; as many mails as there are, so that SQL finds the same."""
    relations, entities = _typed(spark, d)
    mails = spark.range(100).select(F.concat(F.lit("MAIL-"), "id").alias("source"))
    return tr.annotation_sample(relations, entities, mails.select("source", F.concat(F.lit('say "hi"\n'), F.expr("repeat(source, 300)")).alias("text")), n=100)


@query(f"WITH r AS ({_TYPED}) SELECT count(DISTINCT source) AS mails FROM (SELECT DISTINCT source FROM r WHERE source <> 'header' LIMIT 7)")
def email_sample(spark: SparkSession, d: str) -> DataFrame:
    """How many mails a sample of seven has."""
    relations, entities = _typed(spark, d)
    mails = spark.range(100).select(F.concat(F.lit("MAIL-"), "id").alias("source"), F.lit("t").alias("text"))
    everyone = entities.unionByName(relations.select(F.col("end").alias("id")).distinct().select("id", F.lit("Person").alias("type"), F.lit("x").alias("name"), F.lit(0).alias("rid"), F.create_map(F.lit("personName"), F.lit("x")).alias("props")))
    return tr.annotation_sample(relations, everyone, mails, n=7).agg(F.countDistinct("original_source_id").alias("mails"))


_RULES = Ontology({}, {"A": [("Part", "Supplier")], "N": [("Part", "Supplier")], "R": [("Supplier", "Part")]})
_SIDES = """g AS (SELECT 'e' || l_orderkey AS m, 'part' || l_partkey || chr(31) || 'Part' AS s, CASE WHEN l_linenumber = 3 THEN NULL ELSE 's' || l_suppkey || chr(31) || 'Supplier' END AS o, l_returnflag AS p FROM lineitem WHERE l_orderkey % 20 < 10),
    q AS (SELECT 'e' || l_orderkey AS m, 'x' || l_partkey || chr(31) || 'Part' AS s, 's' || l_suppkey || chr(31) || 'Supplier' AS o, CASE WHEN l_linenumber % 2 = 0 THEN 'N' ELSE l_returnflag END AS p FROM lineitem WHERE l_orderkey % 20 > 3)"""


@query(f"""WITH {_SIDES}, ms AS (SELECT DISTINCT m FROM g WHERE m IN (SELECT m FROM q)), gg AS (SELECT * FROM g WHERE m IN (SELECT m FROM ms)), qq AS (SELECT * FROM q WHERE m IN (SELECT m FROM ms)), t AS (SELECT unnest([0.7, 0.9])::DOUBLE AS tau),
    a AS (SELECT DISTINCT m, s AS gold, 'x' || substr(s, 5) AS pred, CASE WHEN substr(s, 5, length(s) - 9)::BIGINT % 2 = 0 THEN 0.8 ELSE 0.95 END AS sim FROM gg), l AS (SELECT tau, m, gold, pred FROM a, t WHERE sim >= tau),
    gv AS (SELECT DISTINCT m, part, x FROM (SELECT m, 'subject' AS part, s AS x FROM gg UNION ALL SELECT m, 'object', o FROM gg UNION ALL SELECT m, 'entity', s FROM gg UNION ALL SELECT m, 'entity', o FROM gg UNION ALL SELECT m, 'predicate', p FROM gg) WHERE x IS NOT NULL),
    qv AS (SELECT DISTINCT m, part, x FROM (SELECT m, 'subject' AS part, s AS x FROM qq UNION ALL SELECT m, 'object', o FROM qq UNION ALL SELECT m, 'entity', s FROM qq UNION ALL SELECT m, 'entity', o FROM qq UNION ALL SELECT m, 'predicate', p FROM qq)),
    tp AS (SELECT tau, part, count(*) AS tp FROM gv JOIN (SELECT DISTINCT tau, m, gold AS x FROM l) USING (m, x) WHERE part <> 'predicate' GROUP BY 1, 2 UNION ALL SELECT tau, part, count(*) FROM gv JOIN qv USING (m, part, x), t WHERE part = 'predicate' GROUP BY 1, 2),
    vp AS (SELECT tau, gp.part, coalesce(tp, 0) AS tp, n_pred, n_gold FROM (SELECT part, count(*) AS n_gold FROM gv GROUP BY 1) gp JOIN (SELECT part, count(*) AS n_pred FROM qv GROUP BY 1) USING (part) CROSS JOIN t LEFT JOIN tp USING (tau, part)),
    gt AS (SELECT DISTINCT m, s, p, o FROM gg WHERE o IS NOT NULL AND p IN ('A', 'N')), qt AS (SELECT DISTINCT tau, qq.m, coalesce(l.gold, s) AS s, p, o FROM qq CROSS JOIN t LEFT JOIN l USING (tau, m) WHERE false UNION SELECT DISTINCT t.tau, qq.m, coalesce(l.gold, s), p, o FROM qq CROSS JOIN t LEFT JOIN l ON l.tau = t.tau AND l.m = qq.m AND l.pred = qq.s WHERE p IN ('A', 'N')),
    every AS (SELECT * FROM vp UNION ALL SELECT tau, 'triple', count(*) FILTER ((m, s, p, o) IN (SELECT (m, s, p, o) FROM gt)), count(*), (SELECT count(*) FROM gt) FROM qt GROUP BY tau)
    SELECT tau, part, tp, n_pred, n_gold, tp / n_pred::DOUBLE AS precision, tp / n_gold::DOUBLE AS recall, CASE WHEN tp > 0 THEN 2 * (tp / n_pred::DOUBLE) * (tp / n_gold::DOUBLE) / (tp / n_pred::DOUBLE + tp / n_gold::DOUBLE) ELSE 0 END AS f1 FROM every""")
def triple_scores(spark: SparkSession, d: str) -> DataFrame:
    """Subjects, objects, entities, predicates and triples against a gold set, at two thresholds of alignment."""
    line = table(spark, d, "lineitem")
    base = [F.concat(F.lit("e"), "l_orderkey").alias("email_id"), F.lit("Part").alias("subject_type"), F.lit("Supplier").alias("object_type"), F.lit("").alias("evidence_sentence")]
    gold = line.where("l_orderkey % 20 < 10").select(*base, F.concat(F.lit(" Part"), "l_partkey").alias("subject_label"), F.expr("case when l_linenumber = 3 then null else concat('S', l_suppkey) end").alias("object_label"), F.col("l_returnflag").alias("predicate"))
    pred = line.where("l_orderkey % 20 > 3").select(*base, F.concat(F.lit("X"), "l_partkey").alias("subject_label"), F.concat(F.lit("s"), "l_suppkey").alias("object_label"), F.expr("case when l_linenumber % 2 = 0 then 'N' else l_returnflag end").alias("predicate"))
    both = line.where("l_orderkey % 20 between 4 and 9").select(F.concat(F.lit("e"), "l_orderkey").alias("email_id"), F.concat(F.lit("part"), "l_partkey", F.lit("\x1fPart")).alias("gold_id"), F.concat(F.lit("x"), "l_partkey", F.lit("\x1fPart")).alias("pred_id"), F.expr("case when l_partkey % 2 = 0 then 0.8D else 0.95D end").alias("similarity")).distinct()
    return tr.triple_scores(gold, pred, both, _RULES, [0.7, 0.9])


@query("SELECT 'e' || conv_id AS email_id, arg_min(text, turn) AS mail_text FROM conversations WHERE turn > 0 GROUP BY 1")
def gold_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The first text of each mail that gold rows state."""
    c = table(spark, d, "conversations")
    return tr.first_contexts(c.select(F.concat(F.lit("e"), "conv_id").alias("email_id"), F.when(F.col("turn") > 0, F.col("text")).alias("full_email_context"), F.col("turn").alias("rid")))


@query("""WITH k AS (SELECT a.p_partkey AS id, arg_min(b.p_brand, b.p_partkey) AS affiliation FROM part a JOIN part b ON b.p_partkey % 4 = 1
    AND (contains(lower(a.p_name), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name)) OR list_has_any(list_filter(string_split(lower(a.p_name), ' '), lambda w: length(w) >= 4), list_filter(string_split(lower(b.p_name), ' '), lambda w: length(w) >= 4))) WHERE a.p_partkey % 4 = 0 GROUP BY 1) SELECT 'p' || id AS id, affiliation FROM k""")
def affiliations(spark: SparkSession, d: str) -> DataFrame:
    """People with an address, given the affiliation of the first one without whose name overlaps."""
    has = lambda k, v, c: F.when(F.expr(c), F.struct(F.lit(k).alias("k"), v.alias("v")))
    props = F.map_from_entries(F.filter(F.array(has("personName", F.col("p_name"), "true"), has("personEmail", F.lit("a@b"), "p_partkey % 4 in (0, 2)"), has("affiliation", F.col("p_brand"), "p_partkey % 4 in (1, 2)")), lambda e: e.isNotNull()))
    people = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Person").alias("type"), F.col("p_partkey").alias("rid"), props.alias("props"))
    patched = er.with_affiliations(people)
    return patched.where((F.col("rid") % 4 == 0) & F.map_contains_key("props", F.lit("affiliation"))).select("id", F.col("props")["affiliation"].alias("affiliation"))


@query("""WITH v AS (SELECT vec_id // 4 AS grp, vec_id AS id, vec_id % 4 AS at, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.grp, a.at AS i, b.at - 2 AS j, a.id AS gold_id, b.id AS pred_id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.grp = b.grp AND a.at < 2 AND b.at > 1),
    t AS (SELECT grp, sum(s) FILTER (i = j) >= sum(s) FILTER (i <> j) AS straight FROM s GROUP BY grp) SELECT grp, gold_id, pred_id, round(s, 6) AS similarity FROM s JOIN t USING (grp) WHERE (i = j) = straight""")
def assignment_of_two(spark: SparkSession, d: str) -> DataFrame:
    """The better of the two assignments of two vectors to two others, for groups of four."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = ev.assigned(v.where("id % 4 < 2"), v.where("id % 4 > 1"), -2.0)
    return out.withColumn("similarity", F.round("similarity", 6))


@query()
def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's first three partners among its nine nearest, in the order of vectors, no pair twice; held against a sequential loop in the tests."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("vec"))
    best = best_partners(v, 9, 0.15).select("kind", F.col("id").alias("i"), F.col("other").alias("j"), "score", "rank")
    return er.capped_pairs(best.withColumns({"id1": F.col("i"), "id2": F.col("j")}))


@query("SELECT a.c_custkey AS id1, b.c_custkey AS id2 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE CASE WHEN a.c_custkey % 3 = 0 THEN jaro_winkler_similarity(a.c_name, b.c_name) >= 0.92 ELSE a.c_custkey % 2 = 0 END")
def name_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one nation whose names are alike, where they are people; half of the others."""
    kind = F.when(F.col("c_custkey") % 3 == 0, F.lit("Person")).when(F.col("c_custkey") % 2 == 0, F.lit("Task"))
    return er.gated_pairs(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp"), kind.alias("kind"), F.col("c_name").alias("name")))


@query("SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm FROM embeddings")
def norms(spark: SparkSession, d: str) -> DataFrame:
    """Inner product of each vector with itself."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("norm"))
