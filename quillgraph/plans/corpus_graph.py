"""Registered queries on the way from messages and model answers to a graph, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import answers, dates, text
from quillgraph.operators import extraction as ex
from quillgraph.operators import graph as g
from quillgraph.operators import resolution as er
from quillgraph.operators.assembly import graph_rows
from quillgraph.plans.registered import query
from quillgraph.plans.starschema import ONTOLOGY, edges, nodes, table
from quillgraph.providers import Replay, judged_answers
from quillgraph.sources import corpus
from quillgraph.sources.staging import shared_dir

_RECORD = "conv_id * 1000 + turn"


@query(f"SELECT row_number() OVER (ORDER BY {_RECORD}) AS record, 'Mail ' || conv_id || '.' || turn || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as a delimited corpus of several files and read back, numbered in order; blank records don't count."""
    path = f"{shared_dir(spark)}/quillgraph/{uuid.uuid4().hex}"
    body = F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    mail = F.concat(F.lit("Mail "), "conv_id", F.lit("."), "turn", F.lit("\n"), body, F.when(F.col("turn") % 2 == 0, F.lit("\nEMAIL_END \n")).otherwise(F.lit("\n")))
    table(spark, d, "conversations").orderBy(F.expr(_RECORD)).select(mail.alias("value")).write.option("lineSep", "EMAIL_END").text(path)
    return corpus.read_records(spark, path)


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """``(record, text)``: messages with headers from the turns of conversations."""
    head = F.concat(F.lit("Thread ID: THR-"), "conv_id", F.lit("\nMail ID: MAIL-"), "conv_id", F.lit("X"), "turn", F.lit("\nDate: "), F.col("turn") + 1, F.lit("-3-2019\nFrom: "), "role", F.lit(" <"), "role", F.lit("@x.org>\nTo: A B [a@b.org]; "), "role", F.lit("\nSubject: Re: Conv "), "conv_id", F.lit("\n\n"))
    return table(spark, d, "conversations").select(F.expr(_RECORD).alias("record"), F.concat(head, "text").alias("text"))


_MENTIONS = f"""c AS (SELECT {_RECORD} AS record, * FROM conversations), m AS (SELECT record, 0 AS pos, 'MailThread' AS type, 'th' AS prefix, 'THR-' || conv_id AS name, 'partOf' AS role FROM c UNION ALL SELECT record, 1, 'Email', 'em', 'MAIL-' || conv_id || 'X' || turn, NULL FROM c
    UNION ALL SELECT record, 2, 'Person', 'me', role || '@x.org', 'sentBy' FROM c UNION ALL SELECT record, 3, 'Person', 'me', 'a@b.org', 'receivedBy' FROM c UNION ALL SELECT record, 4, 'Person', 'me', role, 'receivedBy' FROM c),
    f AS (SELECT type, name, prefix, min(record * 10 + pos) AS first FROM m GROUP BY ALL), i AS (SELECT type, name, prefix || row_number() OVER (PARTITION BY type ORDER BY first) AS id FROM f)"""


@query(f"WITH {_MENTIONS} SELECT DISTINCT record, id, type, name FROM m JOIN i USING (type, name)")
def header_entities(spark: SparkSession, d: str) -> DataFrame:
    """Threads, mails and people of all headers, with ids by first appearance, once a record."""
    m = ex.once_per_record(ex.with_ids(ex.header_mentions(_mails(spark, d))))
    p = F.col("props")
    return m.select("record", "id", "type", F.coalesce(p["threadID"], p["mailNum"], p["personEmail"], p["personName"]).alias("name"))


@query(f"WITH {_MENTIONS} SELECT m.record, s.id AS start_id, i.id AS end_id, m.role AS relation, 'Header Metadata' AS context, 'header' AS source FROM m JOIN i USING (type, name) JOIN m e ON e.record = m.record AND e.pos = 1 JOIN i s ON s.type = 'Email' AND s.name = e.name WHERE m.role IS NOT NULL")
def header_relations(spark: SparkSession, d: str) -> DataFrame:
    return ex.header_relations(ex.with_ids(ex.header_mentions(_mails(spark, d))))


@query(f"WITH {_MENTIONS} SELECT record, 'Persons already extracted from email headers (reuse these IDs):' || string_agg(chr(10) || '- ' || id, '' ORDER BY pos) AS context FROM m JOIN i USING (type, name) WHERE type = 'Person' GROUP BY record")
def header_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a prompt says of the people in a record's headers; their properties left out here."""
    found = ex.person_context(ex.with_ids(ex.header_mentions(_mails(spark, d))))
    return found.select("record", F.regexp_replace("context", r": \{[^\n]*", "").alias("context"))


_TASKS = "t AS (SELECT conv_id % 7 AS task, 't' || row_number() OVER (ORDER BY min(conv_id * 1000 + turn)) AS task_id FROM conversations GROUP BY 1)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Messages with recorded answers: each names its sender again, a task, and a relation of the two."""
    told = F.format_string('{"entities": [{"id": "p1", "type": "Person", "properties": {"personEmail": "%s@X.org"}}, {"id": "x", "type": "Task", "properties": {"taskName": "task %d"}}], "relations": [{"start": "p1", "end": "x", "type": "worksOn"}, {"start": "p1", "end": "nobody", "type": "worksOn"}]', "role", F.col("conv_id") % 7)
    return graph_rows(_mails(spark, d), Replay(table(spark, d, "conversations").select(F.expr(_RECORD).alias("key"), told.alias("answer"))), "Extract.")


@query(f"WITH {_MENTIONS}, {_TASKS} SELECT i.id AS start_id, task_id AS end_id, 'worksOn' AS relation, '' AS context, s.id AS source FROM c JOIN t ON t.task = c.conv_id % 7 JOIN i ON i.type = 'Person' AND i.name = role || '@x.org' JOIN i s ON s.type = 'Email' AND s.name = 'MAIL-' || conv_id || 'X' || turn")
def corpus_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations that answers state, from messages to the graph."""
    return _graph(spark, d)[1].where("source <> 'header'")


@query(f"WITH {_MENTIONS}, {_TASKS} SELECT id, type FROM i UNION ALL SELECT task_id, 'Task' FROM t")
def corpus_entities(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].select("id", "type")


@query("""WITH r AS (SELECT o_orderkey AS record, 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), k AS (SELECT 'c' || o_custkey AS id, min(o_orderkey) + o_custkey % 2 AS first FROM orders GROUP BY o_custkey)
    SELECT record, b AS start_id, a AS end_id, 'placedBy' AS relation, '' AS context FROM r JOIN k ON k.id = r.a WHERE first <= record""")
def temp_ids(spark: SparkSession, d: str) -> DataFrame:
    """Relations between a record's own ids and ids of the graph that appeared no later."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = o.select(F.col("o_orderkey").alias("record"), F.lit(0).alias("rid"), F.lit("e1").alias("start"), F.concat(F.lit("c"), "o_custkey").alias("end"), F.lit("placedBy").alias("relation"), F.lit("").alias("context"))
    local = o.select(F.col("o_orderkey").alias("record"), F.lit("e1").alias("temp_id"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    known = o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg((F.min("o_orderkey") + F.max(F.col("o_custkey") % 2)).alias("first"))
    known = known.union(o.select(F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderkey")))
    return ex.resolved_relations(rows, local, known).drop("rid")


_LINE = "l_orderkey * 8 + l_linenumber"


@query(f"SELECT min({_LINE}) AS rid, 'p' || l_partkey AS start_id, 's' || l_suppkey AS end_id, l_returnflag AS relation, nullif(l_linestatus, 'F') AS context, 'o' || (l_orderkey % 3) AS source FROM lineitem GROUP BY ALL")
def relation_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.expr(_LINE).alias("rid"), F.concat(F.lit("p"), "l_partkey").alias("start_id"), F.concat(F.lit("s"), "l_suppkey").alias("end_id"), F.col("l_returnflag").alias("relation"), F.expr("nullif(l_linestatus, 'F')").alias("context"), F.concat(F.lit("o"), F.col("l_orderkey") % 3).alias("source"))
    return ex.first_rows(rows)


@query("SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS type, max(event_id) AS record FROM events GROUP BY user_id")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Of each id the row of its last record."""
    return ex.last_rows(table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("record")))


@query("SELECT event_type AS type, user_id::VARCHAR AS key, arg_max(value, event_id)::VARCHAR AS last, arg_max(event_id, event_id) FILTER (event_id % 2 = 0)::VARCHAR AS even FROM (SELECT event_type, user_id, event_id, (value * 100)::BIGINT AS value FROM events) GROUP BY 1, 2")
def mention_merge(spark: SparkSession, d: str) -> DataFrame:
    """Properties of an entity, each by the last mention that has it."""
    e = table(spark, d, "events")
    both = F.map_filter(F.create_map(F.lit("last"), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("even"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))), lambda k, v: v.isNotNull())
    m = er.merged_mentions(e.select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("record"), F.lit(0).alias("pos"), both.alias("props")))
    return m.select("type", "key", F.col("props")["last"].alias("last"), F.col("props")["even"].alias("even"))


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kinds = F.expr("case o_orderkey % 4 when 0 then 'Email' when 1 then 'Person' when 2 then 'Task' else 'Person' end")
    o = table(spark, d, "orders")
    e = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), kinds.alias("type"))
    r = o.select(F.concat(F.lit("o"), "o_orderkey").alias("start_id"), F.concat(F.lit("c"), "o_custkey").alias("end_id"), F.col("o_orderstatus").alias("relation"), F.expr("case when o_orderkey % 8 = 3 then 'see Header metadata' end").alias("context"), F.expr("case when o_orderkey % 8 = 1 then 'Header' when o_orderkey % 5 > 0 then 'em1' end").alias("source"))
    return e, r


@query("""WITH e AS (SELECT CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 8 IN (1, 3) THEN 'Regex' ELSE 'LLM' END AS origin, CASE o_orderkey % 4 WHEN 0 THEN 'Email' WHEN 2 THEN 'Task' ELSE 'Person' END AS kind, o_orderstatus AS relation, CASE WHEN o_orderkey % 8 IN (1, 3) THEN 'Regex' ELSE 'LLM' END AS rel_origin FROM orders)
    SELECT 'entities' AS part, origin, kind, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'relations', NULL, relation, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'relations by origin', rel_origin, NULL, count(*) FROM e GROUP BY ALL""")
def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    return ex.extraction_report(*_report(spark, d))


@query("""SELECT event_id, 'u' || user_id AS id, event_type AS type, CASE WHEN event_id % 4 = 1 THEN NULL ELSE value::INT::VARCHAR END AS k, CASE WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 3 THEN 'x' ELSE 'about' END AS relation, CASE event_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 'said' ELSE '' END AS context FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events)""")
def graph_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entities and relations of answers: an object in fences, a list, aliases and missing braces, and text around broken JSON."""
    u, t, k = F.concat(F.lit("u"), "user_id"), F.col("event_type"), F.floor("value").cast("int").cast("string")
    head = F.concat(F.lit('{"id": "'), u, F.lit('", "type": "'), t)
    entity = F.concat(head, F.lit('", "properties": {"k": '), k, F.lit("}}"))
    fenced = F.concat(F.lit('```json\n{"entities": ['), entity, F.lit(', {"id": "None", "type": "t"}, 5], "relations": [{"start": "'), u, F.lit('", "target": "b", "type": "about"}]}\n```'))
    listed = F.concat(F.lit("["), F.lit('{"entities": ['), head, F.lit('"}]}, 7]'))
    cut = F.concat(F.lit('{"entities": ['), entity, F.lit('], "relations": [{"source": "'), u, F.lit('", "end": "b", "relation": "about", "evidence": "said"}]'))
    broken = F.concat(F.lit("Here: "), entity, F.lit(' and {"start_id": "'), u, F.lit('", "end_id": "b", "relation": "x"} { "id": '))
    answer = F.expr("event_id % 4")
    e = table(spark, d, "events").select("event_id", F.when(answer == 0, fenced).when(answer == 1, listed).when(answer == 2, cut).otherwise(broken).alias("answer"))
    x = ex.extracted(e).select("event_id", F.explode("entities").alias("e"), F.get("relations", F.lit(0)).alias("r"))
    return x.select("event_id", "e.id", "e.type", F.col("e.properties")["k"].alias("k"), "r.relation", "r.context")


@query("SELECT count(*) AS triples, count(DISTINCT l_returnflag) AS predicates, count(*) FILTER (l_returnflag IN ('A', 'R')) AS on_schema, count(*) FILTER (l_returnflag IN ('A', 'R')) / count(*)::DOUBLE AS rate FROM lineitem")
def schema_rate(spark: SparkSession, d: str) -> DataFrame:
    return ex.schema_rate(table(spark, d, "lineitem"), ["A", "R"], "l_returnflag")


@query("SELECT event_id, 'u' || user_id AS subject, event_type AS predicate, 'b' AS object FROM events WHERE event_id % 3 < 2")
def loose_triples(spark: SparkSession, d: str) -> DataFrame:
    """Relations of schema-free answers: lists of three, objects, and some without an end."""
    e = table(spark, d, "events")
    shape = F.expr("""case event_id % 3 when 0 then concat('{"relations": [["u', user_id, '", "', event_type, '", "b"]]}') when 1 then concat('[{"start": "u', user_id, '", "edge": "', event_type, '", "target": "b"}]') else '[{"subject": "a", "object": "b"}]' end""")
    return e.select("event_id", F.explode(ex.loose_triples(shape)).alias("t")).select("event_id", "t.*")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN user_id % 2 = 0 ELSE false END AS correct, CASE event_id % 4 WHEN 0 THEN 'both sides have no answer' WHEN 1 THEN event_type WHEN 2 THEN 'no json' END AS reason FROM events""")
def judged_qa(spark: SparkSession, d: str) -> DataFrame:
    """Answers judged by recorded calls; those to questions without an answer need none."""
    e, at = table(spark, d, "events"), F.expr("event_id % 4")
    items = e.select(F.col("event_id").alias("key"), F.lit("q").alias("question"), F.when(at == 0, F.lit("Not available")).otherwise(F.lit("a")).alias("gold"), F.when(at == 0, F.lit("[]")).otherwise(F.lit("x")).alias("output"))
    said = F.when(at == 1, F.format_string('```json\n{"is_useful": %s, "reason": "%s"}\n```', F.expr("user_id % 2 = 0"), "event_type")).when(at == 2, F.lit("no json"))
    told = Replay(e.where(at != 3).select(F.col("event_id").alias("key"), said.alias("answer")))
    return judged_answers(items, told).select(F.col("key").alias("event_id"), "correct", "reason")


_LABELLED = "CASE c_custkey % 6 WHEN 0 THEN 'Person' WHEN 1 THEN 'Paper' WHEN 2 THEN 'PaperStatus' WHEN 3 THEN 'MailThread' WHEN 4 THEN 'Dataset' ELSE 'Thing' END"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 4 > 0, F.col("c_name"))
    keys = F.expr("case c_custkey % 6 when 0 then 'personName' when 1 then 'paperTitle' when 2 then 'statusType' when 3 then 'threadID' when 4 then 'datasetName' else 'other' end")
    props = F.map_from_entries(F.filter(F.array(F.struct(keys.alias("k"), name.alias("v")), F.struct(F.lit("statusDate").alias("k"), F.lit("2020-01-02").alias("v"))), lambda e: e["v"].isNotNull()))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.expr(_LABELLED).alias("type"), props.alias("props"))


@query(f"""WITH k AS (SELECT c_custkey AS rid, {_LABELLED} AS type, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name FROM customer)
    SELECT rid, CASE type WHEN 'Person' THEN 'person_name_' || lower(coalesce(name, '')) WHEN 'Thing' THEN NULL ELSE lower(type) || '_' || lower(coalesce(name, '')) END AS key,
    CASE type WHEN 'PaperStatus' THEN coalesce(name || ' (2020-01-02)', '2020-01-02') WHEN 'MailThread' THEN coalesce('Thread ' || name, 'Unknown Thread') WHEN 'Thing' THEN coalesce(name, '2020-01-02') ELSE coalesce(name, 'Unknown ' || type) END AS label,
    CASE WHEN type IN ('Dataset', 'Person') THEN name END AS blocking, CASE WHEN type IN ('Dataset', 'Person') THEN 'Entity: ' || name || ' | Context: x' END AS embedded FROM k""")
def entity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Keys, labels for people, labels for blocking, and what an encoder is given."""
    t, p = F.col("type"), F.col("props")
    block = text.blocking_label(p)
    return _labelled(spark, d).select("rid", text.canonical_key(t, p).alias("key"), text.display_label(t, p).alias("label"), block.alias("blocking"), text.embedding_text(block, F.lit("x"), "context").alias("embedded"))


@query("""SELECT conv_id, turn, left(replace(replace(text, '"', ''''), chr(10), ' [NEWLINE] '), 1000) AS line, CASE WHEN length(text) > 300 THEN left(text, 300) || '... [truncated]' ELSE text END AS cut, turn % 3 = 0 AND role = 'user' AS none FROM conversations""")
def text_cells(spark: SparkSession, d: str) -> DataFrame:
    """Texts for one cell of a table, cut results, and the test for questions without an answer."""
    t = F.col("text")
    gold, out = F.when(F.col("turn") % 3 == 0, F.lit(" Not available. ")).otherwise(F.lit("yes")), F.when(F.col("role") == "user", F.lit("[]")).otherwise(F.lit("no"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.one_line(t).alias("line"), text.truncated(t, 300).alias("cut"), text.no_answer(gold, out).alias("none"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS day, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%B ') || o || strftime(o_orderdate, ', %Y') WHEN 2 THEN o || strftime(o_orderdate, ' %B %Y') END AS shown
    FROM (SELECT *, day(o_orderdate) || CASE WHEN day(o_orderdate) IN (11, 12, 13) THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS o FROM orders)""")
def date_styles(spark: SparkSession, d: str) -> DataFrame:
    """Header dates read in several styles and written in the same."""
    at, day = F.expr("o_orderkey % 4"), F.col("o_orderdate")
    given = F.when(at == 0, F.date_format(day, "d-M-yyyy")).when(at == 1, F.date_format(day, "MMM d, yyyy")).when(at == 2, F.concat(F.date_format(day, "d"), F.lit("th "), F.date_format(day, "MMMM yyyy"))).otherwise(F.lit("soon"))
    read = dates.corpus_date(given)
    return table(spark, d, "orders").select("o_orderkey", read.alias("day"), dates.like_style(read, given).alias("shown"))


@query("""WITH y AS (SELECT c_custkey, (1995 + c_custkey % 60)::INT AS y FROM customer), b AS (SELECT epoch_us(TIMESTAMP '2019-04-01') AS s, epoch_us(TIMESTAMP '2025-03-31') AS e, epoch_us(TIMESTAMP '2010-01-01') AS lo, epoch_us(TIMESTAMP '2030-01-01') AS hi)
    SELECT c_custkey, CASE WHEN y BETWEEN 2000 AND 2050 THEN year(make_timestamp(least(greatest(s + floor((epoch_us(make_date(y, 7, 1)::TIMESTAMP) - lo)::DOUBLE * ((e - s)::DOUBLE / (hi - lo)::DOUBLE)), s), e)::BIGINT)) ELSE y END::INT AS year FROM y, b""")
def year_shift(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda day: F.unix_micros(F.lit(day).cast("timestamp"))
    year = dates.moved_year((F.lit(1995) + F.col("c_custkey") % 60).cast("int"), micros("2010-01-01"), micros("2030-01-01"), 1_554_076_800_000_000, 1_743_379_200_000_000)
    return table(spark, d, "customer").select("c_custkey", year.cast("int").alias("year"))


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 3")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent types of events, counted and sorted, with their distinct users."""
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return per.orderBy(F.desc("n"), "kind").limit(3)


@query("SELECT n_name AS name, 'n' AS part FROM nation UNION ALL SELECT r_name, NULL FROM region UNION ALL SELECT n_name, 'n' FROM nation WHERE n_regionkey = 1")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several tables by name of column, repeated ones kept and missing columns null."""
    n = table(spark, d, "nation")
    rows = lambda x: x.select(F.col("n_name").alias("name"), F.lit("n").alias("part"))
    return rows(n).unionByName(table(spark, d, "region").select(F.col("r_name").alias("name")), allowMissingColumns=True).unionByName(rows(n.where("n_regionkey = 1")))


@query("SELECT 'c' || c_custkey AS id, c_name AS name, c_mktsegment AS segment, '' AS size FROM customer")
def typed_view(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of one label with a column for each property of the ontology, missing ones empty."""
    return corpus.typed_view(nodes(spark, d), "Customer", ["size", *ONTOLOGY.nodes["Customer"]])


@query("SELECT 'c' || c_custkey AS id, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_alternation(spark: SparkSession, d: str) -> DataFrame:
    """A hop from nodes of either of two labels."""
    p = g.Pattern(g.Node("x", "Customer|Supplier", ("name",)), (g.Hop(("inNation",), g.Node("n", "Nation", ("name",))),))
    return p.match(nodes(spark, d), edges(spark, d), ONTOLOGY).select(F.col("x_id").alias("id"), F.col("n_name").alias("nation"))


@query("""SELECT * FROM (VALUES ('ok', 0), ('direction', 1), ('label', 2), ('property', 1), ('forbidden', 1), ('second hop', 1)) t(name, problems)""")
def pattern_check(spark: SparkSession, d: str) -> DataFrame:
    """How much of some patterns the ontology doesn't have or allow."""
    n, c, r = g.Node("n", "Nation"), g.Node("c", "Customer"), g.Node("r", "Region")
    cases = {"ok": g.Pattern(c, (g.Hop(("inNation",), n), g.Hop(("inRegion",), r))), "direction": g.Pattern(n, (g.Hop(("inNation",), c),)), "label": g.Pattern(g.Node("x", "Email"), (g.Hop(("inRegion",), r),)), "property": g.Pattern(g.Node("n", "Nation", ("size",))), "forbidden": g.Pattern(c, forbidden=frozenset({"Customer"})), "second hop": g.Pattern(c, (g.Hop(("inNation",), n), g.Hop(("placed",), r)))}
    return spark.createDataFrame([(k, len(p.problems(ONTOLOGY))) for k, p in cases.items()], "name string, problems int")


@query("SELECT * FROM (VALUES ('(:Nation)-[:inRegion]->(:Region)'), ('(:Customer)-[:inNation]->(:Nation)'), ('(:Supplier)-[:inNation]->(:Nation)'), ('(:Customer)-[:placed]->(:Order)'), ('(:Order)-[:contains]->(:Part)'), ('(:Part)-[:suppliedBy]->(:Supplier)')) t(path)")
def ontology_paths(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in ONTOLOGY.paths()], "path string")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'x' END AS correct FROM orders WHERE o_orderkey % 3 < 2")
def judge_json(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of a judge's answers, in JSON or not."""
    said = F.when(F.col("o_orderkey") % 3 == 0, F.format_string('{"correct": true, "reason": "%s"', "o_orderstatus")).otherwise(F.lit("x"))
    return table(spark, d, "orders").where("o_orderkey % 3 < 2").select("o_orderkey", answers.judgement(said)["reason"].alias("correct"))
