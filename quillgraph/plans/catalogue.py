"""Registered queries of the graph engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import answers, dates, text, vectors
from quillgraph.operators import entity_dates as ed
from quillgraph.operators import evaluation as ev
from quillgraph.operators import graph as g
from quillgraph.operators import resolution as er
from quillgraph.operators.components import connected_components
from quillgraph.operators.tiles import best_partners, score_classes
from quillgraph.plans import corpus_graph, judged  # noqa: F401  (they register their queries)
from quillgraph.plans.registered import QUERIES, SQL, query
from quillgraph.plans.starschema import ONTOLOGY, edges, nodes, table
from quillgraph.sources.corpus import unprocessed
from quillgraph.sources.staging import small_enough

REGION, NATION = g.Node("r", "Region", ("name",)), g.Node("n", "Nation", ("name",))
CUSTOMER, ORDER, PART = g.Node("c", "Customer", ("name", "segment")), g.Node("o", "Order", ("status", "date", "priority")), g.Node("p", "Part", ("name", "brand", "kind"))
BLOCK_TAU, COMPONENT_TAU, NEIGHBOURS = 0.25, 0.30, 9


def _match(spark: SparkSession, d: str, start: g.Node, *hops: g.Hop) -> DataFrame:
    return g.Pattern(start, hops).match(nodes(spark, d), edges(spark, d), ONTOLOGY)


@query("SELECT DISTINCT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%asia%'")
def hop1(spark: SparkSession, d: str) -> DataFrame:
    m = _match(spark, d, NATION, g.Hop(("inRegion",), REGION))
    return m.where(g.contains(F.col("r_name"), "Asia")).select(F.col("n_name").alias("nation")).distinct()


@query("SELECT DISTINCT r_name AS region, c_name AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(c_mktsegment) LIKE '%auto%'")
def hop2(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment with their region: two hops over a typed graph."""
    m = _match(spark, d, CUSTOMER, g.Hop(("inNation",), NATION), g.Hop(("inRegion",), REGION))
    return m.where(g.contains(F.col("c_segment"), "auto")).select(F.col("r_name").alias("region"), F.col("c_name").alias("customer")).distinct()


@query("""SELECT r_name AS region, p_brand AS brand, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE lower(p_name) LIKE '%ring%' GROUP BY 1, 2""")
def hop4(spark: SparkSession, d: str) -> DataFrame:
    m = _match(spark, d, PART, g.Hop(("contains",), ORDER, "<"), g.Hop(("placed",), CUSTOMER, "<"), g.Hop(("inNation",), NATION), g.Hop(("inRegion",), REGION))
    m = m.where(g.contains(F.col("p_name"), "ring"))
    return m.groupBy(F.col("r_name").alias("region"), F.col("p_brand").alias("brand")).agg(F.countDistinct("c_id").alias("n"))


@query("SELECT count(o_orderkey) > 0 AS result FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND lower(c_mktsegment) LIKE '%build%'")
def yes_no(spark: SparkSession, d: str) -> DataFrame:
    m = _match(spark, d, CUSTOMER, g.Hop(("placed",), ORDER))
    return g.any_match(m.where((F.col("o_status") == "F") & g.contains(F.col("c_segment"), "build")), "o_id")


@query("SELECT 'c' || c_custkey AS customer, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1998 AND o_orderdate < DATE '1998-07-01' GROUP BY 1")
def date_year(spark: SparkSession, d: str) -> DataFrame:
    m = _match(spark, d, CUSTOMER, g.Hop(("placed",), ORDER))
    day = g.as_date(F.col("o_date"))
    return m.where((F.year(day) == 1998) & (day < F.lit("1998-07-01").cast("date"))).groupBy(F.col("c_id").alias("customer")).agg(F.count("*").alias("n"))


@query("SELECT 'o' || o_orderkey AS \"order\" FROM orders WHERE month(o_orderdate) = 7 AND day(o_orderdate) = 4")
def date_month_day(spark: SparkSession, d: str) -> DataFrame:
    day = g.as_date(F.col("o_date"))
    return _match(spark, d, ORDER).where((F.month(day) == 7) & (F.dayofmonth(day) == 4)).select(F.col("o_id").alias("order"))


@query("SELECT 'o' || o_orderkey AS \"order\" FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '%1997-05%'")
def date_partial(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, ORDER).where(F.col("o_date").contains("1997-05")).select(F.col("o_id").alias("order"))


@query("SELECT DISTINCT p_name AS part, p_kind AS kind FROM (SELECT p_name, p_type AS p_kind FROM part) WHERE lower(p_name) LIKE '%blue%' OR lower(p_kind) LIKE '%promo%'")
def or_compound(spark: SparkSession, d: str) -> DataFrame:
    m = _match(spark, d, PART)
    return m.where(g.contains(F.col("p_name"), "BLUE") | g.contains(F.col("p_kind"), "promo")).select(F.col("p_name").alias("part"), F.col("p_kind").alias("kind")).distinct()


@query("SELECT n_name AS nation, 'c' || c_custkey AS other FROM nation JOIN customer ON c_nationkey = n_nationkey")
def undirected(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, NATION, g.Hop(("inNation",), CUSTOMER, "-")).select(F.col("n_name").alias("nation"), F.col("c_id").alias("other"))


@query("SELECT 'Not available' AS answer")
def missing_path(spark: SparkSession, d: str) -> DataFrame:
    """A pattern the ontology lacks is answered by a constant."""
    pattern = g.Pattern(REGION, (g.Hop(("placed",), ORDER),))
    return spark.createDataFrame([("Not available" if pattern.problems(ONTOLOGY) else "available",)], "answer string")


@query("""SELECT label, properties FROM (VALUES ('Region', 'name'), ('Nation', 'name'), ('Supplier', 'name'), ('Customer', 'name, segment'), ('Order', 'date, priority, status'), ('Part', 'brand, kind, name')) t(label, properties)""")
def schema(spark: SparkSession, d: str) -> DataFrame:
    return g.schema_text(nodes(spark, d))


_FEW = "o_orderkey % 10 = 0"


@query(f"""SELECT 'Customer' AS type, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_FEW}) HAVING count(*) > 0
    UNION ALL SELECT 'Order', count(*) FROM orders WHERE NOT {_FEW} HAVING count(*) > 0""")
def unconnected(spark: SparkSession, d: str) -> DataFrame:
    """Customers and orders that no edge of a tenth of the orders reaches."""
    own = nodes(spark, d).where(F.col("label").isin("Customer", "Order")).select("id", F.col("label").alias("type"))
    some = table(spark, d, "orders").where(_FEW).select(F.concat(F.lit("c"), "o_custkey").alias("start"), F.concat(F.lit("o"), "o_orderkey").alias("end"))
    return g.unconnected(own, some)


@query(f"SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_FEW})")
def connected(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(F.concat(F.lit(" c"), "c_custkey").alias("id"))
    some = table(spark, d, "orders").where(_FEW).select(F.concat(F.lit("c"), "o_custkey", F.lit(" ")).alias("start"), F.concat(F.lit("o"), "o_orderkey").alias("end"))
    return g.connected(own, some).select(F.trim("id").alias("id"))


@query("SELECT event_type AS type, event_id AS id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('view', 'purchase')")
def property_whitelist(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.sources.corpus import Ontology

    own = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("id"), g.parse_properties(F.col("props")).alias("props"))
    return g.clean_nodes(own, Ontology({"view": ["k"], "purchase": ["k", "none"]}, {})).select("type", "id", F.col("props")["k"].alias("k"))


@query("SELECT 'o' || o_orderkey AS start, 'c' || o_custkey AS \"end\", relation FROM orders, (VALUES ('placedBy'), ('sentTo')) r(relation) WHERE relation = 'placedBy'")
def ontology_clean(spark: SparkSession, d: str) -> DataFrame:
    """Edges of two relations, of which the ontology has one for these types."""
    from quillgraph.sources.corpus import Ontology

    o = Ontology({"Order": [], "Customer": []}, {"placedBy": [("Order", "Customer")], "sentTo": [("Customer", "Order")]})
    kinds = nodes(spark, d).where(F.col("label").isin("Order", "Customer")).select("id", F.col("label").alias("type"))
    rows = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("start"), F.concat(F.lit("c"), "o_custkey").alias("end"), F.explode(F.array(F.lit("placedBy"), F.lit("sentTo"))).alias("relation"))
    return g.clean_edges(rows, kinds, o)


_ORDER = "l_orderkey * 8 + l_linenumber"


@query(f"SELECT 'Part' AS label, 'p' || l_partkey AS id, arg_max(l_returnflag, struct_pack(a := {_ORDER}, b := l_suppkey, c := l_quantity, d := l_extendedprice)) FILTER (l_returnflag <> 'N') AS flag, arg_max(l_linestatus, struct_pack(a := {_ORDER}, b := l_suppkey, c := l_quantity, d := l_extendedprice)) AS status FROM lineitem GROUP BY l_partkey")
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.lit("Part").alias("label"), F.concat(F.lit("p"), "l_partkey").alias("id"), F.expr(f"named_struct('a', {_ORDER}, 'b', l_suppkey, 'c', l_quantity, 'd', l_extendedprice)").alias("at"), F.expr("nullif(l_returnflag, 'N')").alias("flag"), F.col("l_linestatus").alias("status"))
    return g.upsert_nodes(rows, "at", ["flag", "status"])


@query(f"SELECT 'p' || l_partkey AS start, 'suppliedBy' AS type, 's' || l_suppkey AS \"end\", arg_max(l_returnflag, struct_pack(a := {_ORDER}, c := l_quantity, d := l_extendedprice)) FILTER (l_returnflag <> 'N') AS context FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY l_partkey, l_suppkey")
def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("start"), F.lit("suppliedBy").alias("type"), F.concat(F.lit("s"), "l_suppkey").alias("end"), F.expr(f"named_struct('a', {_ORDER}, 'c', l_quantity, 'd', l_extendedprice)").alias("at"), F.expr("nullif(l_returnflag, 'N')").alias("context"))
    return g.upsert_edges(rows, nodes(spark, d).where(F.col("label").isin("Part", "Supplier")), "at", ["context"])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("vec"))


_PAIRS = "SELECT a.label AS kind, a.vec_id AS id1, b.vec_id AS id2, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"


@query(f"""WITH p AS (SELECT * FROM ({_PAIRS}) WHERE score > {BLOCK_TAU}), b AS (SELECT kind, id1 AS id, id2 AS other, score FROM p UNION ALL SELECT kind, id2, id1, score FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS r FROM b)
    SELECT kind, least(id, other) AS id1, greatest(id, other) AS id2, max(score) AS score FROM k WHERE r <= {NEIGHBOURS} GROUP BY 1, 2, 3""")
def blocking_topk(spark: SparkSession, d: str) -> DataFrame:
    return er.nearest_pairs(_vectors(spark, d), NEIGHBOURS, BLOCK_TAU)


@query(f"""WITH RECURSIVE p AS (SELECT 'me' || id1 AS a, 'me' || id2 AS b FROM ({_PAIRS}) WHERE score > {COMPONENT_TAU}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
    SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_me(er.similar_pairs(_vectors(spark, d), COMPONENT_TAU)))


def _me(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.concat(F.lit("me"), "id1").alias("a"), F.concat(F.lit("me"), "id2").alias("b"))


_MAP = "(SELECT 'p' || p_partkey AS node, 'p' || min(p_partkey::VARCHAR) OVER (PARTITION BY p_name) AS component FROM part)"


def _part_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one name as one, by components over a star of each name's parts."""
    p = table(spark, d, "part").select("p_name", F.concat(F.lit("p"), "p_partkey").alias("id"))
    heads = p.groupBy("p_name").agg(F.min("id").alias("head"))
    return connected_components(p.join(heads, "p_name").select(F.col("id").alias("a"), F.col("head").alias("b")))


@query(f"""WITH m AS {_MAP}, e AS (SELECT DISTINCT coalesce(component, 'p' || l_partkey) AS start, 's' || l_suppkey AS "end", l_returnflag AS relation, l_linestatus AS context FROM lineitem LEFT JOIN m ON node = 'p' || l_partkey) SELECT * FROM e""")
def fusion_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("start"), F.concat(F.lit("s"), "l_suppkey").alias("end"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("context"), F.expr(_ORDER).alias("rid"))
    return er.remap_edges(rows, _part_clusters(spark, d)).drop("rid")


@query(f"""WITH m AS {_MAP}, r AS (SELECT component, node, p_brand, CASE WHEN p_size > 25 THEN p_type END AS kind FROM part JOIN m ON node = 'p' || p_partkey)
    SELECT component AS id, arg_min(p_brand, struct_pack(a := node <> component, b := node)) AS brand, arg_min(kind, struct_pack(a := node <> component, b := node)) FILTER (kind IS NOT NULL) AS kind FROM r GROUP BY 1""")
def fusion_props(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.expr("case when p_size > 25 then p_type end")), lambda k, v: v.isNotNull()).alias("props"))
    merged = er.merge_properties(own, _part_clusters(spark, d))
    return merged.select("id", F.col("props")["brand"].alias("brand"), F.col("props")["kind"].alias("kind"))


_SCORED = "SELECT least(1.0, greatest(0.0, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6))) AS score, a.label = b.label AS truth, a.vec_id AS id1, b.vec_id AS id2 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query(f"""WITH s AS ({_SCORED}), b AS (SELECT least(floor(score * 999 + 1e-9), 999)::BIGINT AS bin, count(*) AS n, sum(truth::INT) AS t FROM s GROUP BY 1), q AS (SELECT unnest(range(1000)) AS bin),
    c AS (SELECT q.bin, sum(coalesce(t, 0)) OVER w AS tp, sum(coalesce(n, 0)) OVER w AS predicted FROM q LEFT JOIN b USING (bin) WINDOW w AS (ORDER BY q.bin DESC ROWS UNBOUNDED PRECEDING))
    SELECT bin AS point, bin / 999.0::DOUBLE AS threshold, tp::BIGINT AS tp, predicted::BIGINT AS predicted, (SELECT sum(t) FROM b)::BIGINT AS actual, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted::DOUBLE ELSE 1.0 END AS precision, tp::DOUBLE / (SELECT sum(t) FROM b)::DOUBLE AS recall FROM c""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return er.pair_sweep(_vectors(spark, d))


@query(f"WITH s AS ({_SCORED}), c AS (SELECT count(*) FILTER (truth AND score >= 0.2) AS tp, count(*) FILTER (NOT truth AND score >= 0.2) AS fp, count(*) FILTER (truth AND score < 0.2) AS fn FROM s) SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c")
def prf(spark: SparkSession, d: str) -> DataFrame:
    counts = score_classes(_vectors(spark, d), lambda s: s >= 0.2)
    return ev.prf(counts.select(F.col("same").alias("truth"), (F.col("class") == 1).alias("predicted"), "n"), n="n")


@query(f"""WITH s AS ({_SCORED}), r AS (SELECT truth, row_number() OVER (PARTITION BY id1 ORDER BY score DESC, id2) AS rank FROM s), k AS (SELECT unnest(range(1, 11)) AS k)
    SELECT k::INT AS k, (SELECT count(*) FROM r WHERE truth AND rank <= k) / (SELECT count(*) FROM r WHERE truth)::DOUBLE AS recall FROM k""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    best = best_partners(v, 10, kinds=False, later=True, clamped=True)
    return ev.recall_at(best.select((F.col("kind") == F.col("other_kind")).alias("truth"), "rank"), total=ev.pairs_of_a_kind(v))


@query("SELECT count(*) AS n FROM orders a JOIN customer c ON a.o_custkey = c.c_custkey WHERE (CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) IS NOT DISTINCT FROM (CASE WHEN c_acctbal > 5000 THEN '2-HIGH' END)")
def strict_gate(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = F.create_map(F.lit("taskDate"), F.expr("case when o_orderstatus = 'F' then o_orderpriority end"))
    b = F.create_map(F.lit("taskDate"), F.expr("case when c_acctbal > 5000 then '2-HIGH' end"))
    return m.where(er.strict_gate(a, b, ("taskDate",))).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT event_type AS type, user_id, min(event_id) AS first_ FROM events GROUP BY 1, 2) SELECT type, user_id::VARCHAR AS key, left(type, 2) || row_number() OVER (PARTITION BY type ORDER BY first_) AS id FROM f")
def registry_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("record"), F.lit(0).alias("pos"))
    return er.registry(m, {t: t[:2] for t in ("view", "click", "error", "signup", "purchase")})


_MESSAGE = "'Thread ID: THR-' || conv_id || chr(10) || 'Mail ID: MAIL-' || turn || chr(10) || 'Date: ' || (turn + 1) || '-3-2019' || chr(10) || 'From: ' || role || ' <' || role || '@x.org>' || chr(10) || 'To: A B [a@b.org]; ' || role || chr(10) || 'Subject: Re: Conv ' || conv_id || chr(10) || chr(10) || text"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.expr(_MESSAGE.replace("chr(10)", "'\\n'")).alias("message"))


@query("SELECT conv_id, turn, 'THR-' || conv_id AS thread_id, 'MAIL-' || turn AS mail_id, '2019-03-' || lpad((turn + 1)::VARCHAR, 2, '0') AS date, 'Re: Conv ' || conv_id AS subject, 'conv ' || conv_id AS thread, trim(text, ' ' || chr(10)) AS body, 'e' || turn AS mail_key FROM conversations")
def header_parse(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("h", text.headers(F.col("message")))
    return m.select("conv_id", "turn", "h.thread_id", "h.mail_id", dates.header_date(F.col("h.date")).alias("date"), "h.subject", text.thread_subject(F.col("h.subject")).alias("thread"), text.body(F.col("message")).alias("body"), text.mail_key(F.col("h.mail_id")).alias("mail_key"))


@query("""SELECT conv_id, turn, 'from' AS field, role AS name, role || '@x.org' AS email FROM conversations UNION ALL SELECT conv_id, turn, 'to', 'A B', 'a@b.org' FROM conversations UNION ALL SELECT conv_id, turn, 'to', role, NULL FROM conversations""")
def address_list(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("h", text.headers(F.col("message")))
    each = m.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("from").alias("field"), F.col("h.sender").alias("v")), F.struct(F.lit("to").alias("field"), F.col("h.to").alias("v")))).alias("x"))
    return each.select("conv_id", "turn", "x.field", F.explode(text.addresses(F.col("x.v"))).alias("a")).select("conv_id", "turn", "field", "a.name", "a.email")


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS record, CASE WHEN turn % 5 = 4 THEN '' ELSE 'conv ' || conv_id END AS key FROM conversations), k AS (SELECT record, CASE WHEN key = '' THEN '#' || record ELSE key END AS key FROM r)
    SELECT record, min(record) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS n FROM k""")
def thread_regroup(spark: SparkSession, d: str) -> DataFrame:
    """Records of one subject share a thread; those without one are alone."""
    subject = F.expr("case when turn % 5 = 4 then ' Re: ' else concat('RE:  Fwd: Conv  ', conv_id) end")
    own = ed.regrouped_threads(table(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("record"), subject.alias("subject")))
    per = own.groupBy("thread").agg(F.min("record").alias("first"), F.count("*").alias("n"))
    return own.join(per, "thread").select("record", "first", "n")


_STYLES = {0: ("d MMMM yyyy", "%-d %B %Y"), 1: ("yyyy-MM-dd", "%Y-%m-%d"), 2: ("d/M/yyyy", "%-d/%-m/%Y"), 3: ("MMMM d, yyyy", "%B %-d, %Y"), 4: ("EEEE, d MMM yyyy", "%A, %-d %b %Y")}


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Dates in five styles, back as ISO."""
    style = F.pmod("o_orderkey", F.lit(len(_STYLES)))
    shown = F.coalesce(*[F.when(style == k, F.date_format("o_orderdate", f)) for k, (f, _) in _STYLES.items()])
    return table(spark, d, "orders").select("o_orderkey", dates.normalize_date(shown).alias("date"))


def _dated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and orders as their mails, as entities; relations of customers that name an order's mail."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    mails = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.create_map(F.lit("mailDate"), F.when(F.expr("o_orderkey % 3 > 0"), F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.lit("TBD"))).alias("props"))
    people = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.create_map(F.lit("statusDate"), F.when(F.expr("c_custkey % 2 = 0"), F.lit("2001-05-06")).otherwise(F.lit("5 May")), F.lit("name"), F.col("c_name")).alias("props"))
    relations = o.where(_FEW).select(F.concat(F.lit("c"), "o_custkey").alias("start"), F.concat(F.lit("c"), "o_custkey").alias("end"), F.when(F.expr("o_orderkey % 20 = 0"), F.lit("header")).otherwise(F.concat(F.lit("o"), "o_orderkey")).alias("source"))
    return mails.unionByName(people), relations


_YEARS = f"""t AS (SELECT 'c' || o_custkey AS id, arg_min(year(o_orderdate), (length(o_orderkey::VARCHAR), o_orderkey::VARCHAR)) AS y FROM orders WHERE {_FEW} AND o_orderkey % 20 <> 0 AND o_orderkey % 3 > 0 GROUP BY 1),
    y AS (SELECT 'c' || c_custkey AS id, coalesce(t.y, CASE WHEN c_custkey % 2 = 0 THEN 2001 END, 2019)::INT AS year FROM customer LEFT JOIN t ON t.id = 'c' || c_custkey UNION ALL SELECT 'o' || o_orderkey, 2019 FROM orders)"""


@query(f"WITH {_YEARS} SELECT id, year FROM y")
def year_infer(spark: SparkSession, d: str) -> DataFrame:
    return ed.entity_years(*_dated(spark, d))


@query(f"""WITH {_YEARS} SELECT id, CASE WHEN left(id, 1) = 'o' THEN CASE WHEN substr(id, 2)::BIGINT % 3 > 0 THEN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderkey = substr(id, 2)::BIGINT) ELSE 'TBD' END
    ELSE CASE WHEN substr(id, 2)::BIGINT % 2 = 0 THEN '2001-05-06' ELSE year || '-05-05' END END AS date, CASE WHEN left(id, 1) = 'o' THEN substr(id, 2)::BIGINT % 3 > 0 ELSE substr(id, 2)::BIGINT % 2 <> 0 END AS changed FROM y""")
def entity_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates among the properties as ISO text, with the years that they lack."""
    entities, relations = _dated(spark, d)
    fixed = ed.normalized_entities(entities, ed.entity_years(entities, relations))
    return fixed.select("id", F.coalesce(F.col("props")["mailDate"], F.col("props")["statusDate"]).alias("date"), "changed")


_FROM, _TO = 1_600_000_000_000_000, 1_610_000_000_000_000


@query(f"WITH r AS (SELECT event_id, epoch_us(ts) AS t FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM r) SELECT event_id, least(greatest({_FROM} + floor((t - lo)::DOUBLE * ({float(_TO - _FROM)!r}::DOUBLE / (hi - lo)::DOUBLE)), {_FROM}), {_TO})::BIGINT AS moved FROM r, b")
def time_rescale(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", t.alias("t"))
    bounds = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return e.crossJoin(F.broadcast(bounds)).select("event_id", dates.rescale(F.col("t"), F.col("lo"), F.col("hi"), _FROM, _TO).alias("moved"))


@query("""WITH r AS (SELECT conv_id * 1000 + turn AS rid, 'c' || conv_id AS a, role AS b, text FROM conversations), e AS (SELECT rid, 0 AS pos, a AS id, text FROM r UNION ALL SELECT rid, 1, b, text FROM r), i AS (SELECT DISTINCT id FROM e UNION SELECT 'nobody')
    SELECT i.id, coalesce(string_agg(text, ' | ' ORDER BY rid, pos) FILTER (trim(text) <> ''), 'Missing') AS context FROM i LEFT JOIN e ON i.id = e.id GROUP BY 1""")
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "conversations").select(F.expr("conv_id * 1000 + turn").alias("rid"), F.concat(F.lit("c"), "conv_id").alias("start"), F.col("role").alias("end"), F.col("text").alias("context"))
    ids = r.select(F.col("start").alias("id")).union(r.select("end")).union(spark.createDataFrame([("nobody",)], "id string")).distinct()
    return er.contexts(r, ids)


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, max(v) AS v FROM x GROUP BY 1, 2), p AS (SELECT label, list(v ORDER BY i) AS v FROM m GROUP BY 1)
    SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM p a JOIN p b ON a.label < b.label""")
def maxpool_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = ev.max_pool(_vectors(spark, d), "kind")
    a, b = p.toDF("a", "va"), p.toDF("b", "vb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


_TRIPLES = "SELECT DISTINCT l_orderkey AS grp, l_partkey AS s, l_returnflag AS r, l_suppkey AS o FROM lineitem"


@query(f"""WITH t AS ({_TRIPLES}), p AS (SELECT DISTINCT grp, s, CASE WHEN s % 5 = 0 THEN 'X' ELSE r END AS r, o FROM t WHERE grp % 7 <> 0), k AS (SELECT DISTINCT grp FROM p),
    c AS (SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM t WHERE grp IN (SELECT grp FROM k)) AS n_gold)
    SELECT tp, n_pred, n_gold, tp / n_pred::DOUBLE AS precision, tp / n_gold::DOUBLE AS recall, 2 * tp / (n_pred + n_gold)::DOUBLE AS f1 FROM c""")
def triple_prf(spark: SparkSession, d: str) -> DataFrame:
    """All triples against a perturbed copy that lacks some groups; groups of one side don't count."""
    gold = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("s"), F.col("l_returnflag").alias("r"), F.col("l_suppkey").alias("o"))
    pred = gold.where("grp % 7 <> 0").withColumn("r", F.expr("case when s % 5 = 0 then 'X' else r end"))
    return ev.set_scores(gold, pred, ["s", "r", "o"], "grp")


@query("SELECT toxic::VARCHAR AS kind, count(*) AS n, round(avg(quality) * 100, 2) AS accuracy FROM labels GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(quality) * 100, 2) FROM labels")
def accuracy_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ev.accuracy(table(spark, d, "labels"), "toxic", "quality")


@query()
def assignment(spark: SparkSession, d: str) -> DataFrame:
    """Best one-to-one assignment of each label's even vectors to its odd ones."""
    v = _vectors(spark, d).select(F.col("kind").alias("grp"), "id", "vec")
    return ev.assigned(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.2)


@query(f"""WITH p AS (SELECT count(*) AS n FROM ({_PAIRS}) WHERE score > 0.2) SELECT CASE WHEN n < 1000 THEN floor(n * 0.4) WHEN n < 5000 THEN least(500, floor(n * 0.15)) ELSE 500 END::BIGINT AS n FROM p""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    pairs = er.similar_pairs(_vectors(spark, d), 0.2)
    return er.stratified_sample(pairs, "kind", ["id1", "id2"]).agg(F.countDistinct("id1", "id2").alias("n"))


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "nation").select("n_nationkey", "n_name")


_TITLED = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Editorial ' || p_name ELSE 'Dr. ' || (SELECT min(n_name) FROM nation) END"
_NAMED = "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'editorial ' || split_part((SELECT p_name FROM part WHERE p_partkey = n_nationkey + 1), ' ', 1) END"


@query(f"""WITH a AS (SELECT p_partkey, lower({_TITLED}) AS x FROM part), b AS (SELECT n_nationkey, lower({_NAMED}) AS y FROM nation),
    w AS (SELECT p_partkey, x, list_filter(string_split(x, ' '), lambda v: length(v) >= 4 AND v NOT IN ('editorial')) AS xs FROM a), v AS (SELECT n_nationkey, y, list_filter(string_split(y, ' '), lambda v: length(v) >= 4 AND v NOT IN ('editorial')) AS ys FROM b)
    SELECT p_partkey, n_nationkey FROM w, v WHERE length(y) >= 4 AND (contains(x, y) OR contains(y, x) OR list_has_any(xs, ys))""")
def name_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Names that overlap by a word, by lying in each other or not at all; a shared title is no overlap."""
    p, n = table(spark, d, "part").select("p_partkey", "p_name"), table(spark, d, "nation").select("n_nationkey", "n_name")
    least = n.agg(F.min("n_name").alias("least"))
    a = p.crossJoin(F.broadcast(least)).select(F.col("p_partkey").alias("id"), F.expr("case p_partkey % 3 when 0 then p_name when 1 then 'Editorial ' || p_name else 'Dr. ' || least end").alias("name"))
    b = n.join(p, F.col("p_partkey") == F.col("n_nationkey") + 1, "left").select(F.col("n_nationkey").alias("id"), F.expr("case when n_nationkey % 2 = 0 then n_name else 'editorial ' || split_part(p_name, ' ', 1) end").alias("name"))
    # The keyed way, as for large tables.
    return er.overlapping_names(a, b, small=0).toDF("p_partkey", "n_nationkey")


@query("SELECT s_suppkey, n_nationkey, round(jaro_winkler_similarity(lower(s_name), lower(n_name)), 6) AS similarity FROM supplier, nation")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    s, n = _people(spark, d)
    return s.crossJoin(F.broadcast(n) if small_enough(n, 10_000) else n).select("s_suppkey", "n_nationkey", F.round(vectors.jaro_winkler(F.lower("s_name"), F.lower("n_name")), 6).alias("similarity"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MATCH' ELSE 'NO_MATCH' END AS verdict FROM orders")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    said: Column = F.expr("elt(cast(o_orderkey % 4 as int) + 1, 'Verdict: match.', 'NO_MATCH', 'no match', 'unsure')")
    return table(spark, d, "orders").select("o_orderkey", text.verdict(said).alias("verdict"))


@query("SELECT event_id, 'u' || user_id AS id, event_type AS type FROM events")
def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entities of answers in fences, some without their last braces."""
    whole = F.format_string('```json\n{"entities": [{"id": "u%d", "type": "%s"}]}\n```', "user_id", "event_type")
    cut = F.format_string('{"entities": [{"id": "u%d", "type": "%s"}]', "user_id", "event_type")
    given = F.when(F.col("event_id") % 2 == 0, whole).otherwise(cut)
    items = answers.json_items(given, "entities", "struct<id:string,type:string>")
    return table(spark, d, "events").select("event_id", F.explode(items).alias("x")).select("event_id", "x.id", "x.type")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_FEW})")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """Customers that a tenth of the orders hasn't dealt with."""
    return unprocessed(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where(_FEW).select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
