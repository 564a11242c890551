"""From messages and model answers to the rows of a graph: mentions, ids, relations, their merge and their report.

A mention is ``(record, pos, type, props)``: what a record says of an entity, at
the place ``pos`` within it. Ids are given to all mentions at once, in the order
in which their keys first appear, so that no record waits for an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import answers as model
from quillgraph.functions import dates, text
from quillgraph.operators.resolution import registry

#: Letters of ids by type, and the context of relations that headers state.
PREFIXES = {"Person": "me", "Email": "em", "MailThread": "th", "Paper": "pa", "PaperBib": "pb", "PaperStatus": "ps", "SubmissionID": "si", "Conference": "co", "Journal": "jo", "Dataset": "d", "Method": "m", "Task": "t", "Metric": "mt", "Meeting": "mg"}
HEADER_CONTEXT = "Header Metadata"


def _map(**fields: Column) -> Column:
    """Properties that have a value."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def header_mentions(records: DataFrame) -> DataFrame:
    """``(record, pos, type, props, role)`` of the threads, mails and people that the headers of ``(record, text)`` name.

    ``role`` is the relation of the record's mail to the mention; its own mention has none.
    """
    h = records.select("record", text.headers(F.col("text")).alias("h"))

    def mention(kind: str, role: str | None, props: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(role).cast("string").alias("role"), props.alias("props"))

    def people(field: str, role: str) -> Column:
        each = F.transform(text.addresses(F.col(f"h.{field}")), lambda p: mention("Person", role, _map(personName=p["name"], personEmail=p["email"], affiliation=p["affiliation"])))
        return F.coalesce(each, F.array().cast("array<struct<type:string,role:string,props:map<string,string>>>"))

    thread = F.when(F.col("h.thread_id").isNotNull(), mention("MailThread", "partOf", _map(threadID=F.col("h.thread_id"), subject=F.col("h.subject"))))
    mail = F.when(F.col("h.mail_id").isNotNull(), mention("Email", None, _map(mailNum=F.col("h.mail_id"), mailDate=dates.header_date(F.col("h.date")))))
    every = F.concat(F.filter(F.array(thread, mail), lambda m: m.isNotNull()), people("sender", "sentBy"), people("to", "receivedBy"), people("cc", "receivedBy"))
    return h.select("record", F.posexplode(every).alias("pos", "m")).select("record", "pos", "m.type", "m.props", "m.role")


def keyed(mentions: DataFrame) -> DataFrame:
    """``mentions`` with the ``key`` that makes them one entity; a type without a naming property stays by itself."""
    alone = F.concat(F.lower("type"), F.lit("_#"), F.col("record").cast("string"), F.lit("#"), F.col("pos").cast("string"))
    return mentions.withColumn("key", F.coalesce(text.canonical_key(F.col("type"), F.col("props")), alone))


def with_ids(mentions: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``mentions`` with key and id, by first appearance."""
    own = keyed(mentions)
    return own.join(registry(own, PREFIXES if prefixes is None else prefixes), ["type", "key"])


def header_relations(mentions: DataFrame) -> DataFrame:
    """``(record, start_id, end_id, relation, context, source)`` from a record's mail to what its headers name."""
    mail = mentions.where("type = 'Email' and role is null").groupBy("record").agg(F.min_by("id", "pos").alias("start_id"))
    return mentions.where("role is not null").join(mail, "record").select("record", "start_id", F.col("id").alias("end_id"), F.col("role").alias("relation"), F.lit(HEADER_CONTEXT).alias("context"), F.lit("header").alias("source"))


def once_per_record(mentions: DataFrame) -> DataFrame:
    """The first mention of each id in a record."""
    others = [c for c in mentions.columns if c not in ("record", "id")]
    return mentions.groupBy("record", "id").agg(*[F.min_by(c, "pos").alias(c) for c in others]).select(*mentions.columns)


def resolved_relations(relations: DataFrame, local: DataFrame, known: DataFrame) -> DataFrame:
    """``(record, rid, start_id, end_id, relation, context)`` with a record's own ids replaced by those of the graph.

    ``relations(record, rid, start, end, relation, context)`` name ends by the ids
    of ``local(record, temp_id, id)``, or else by an id of the graph. An end is
    valid if ``known(id, first)`` has it no later than the record; other rows go.
    """
    out = relations
    for end in ("start", "end"):
        mapped = local.groupBy("record", F.col("temp_id").alias(end)).agg(F.max("id").alias("_own"))
        seen = known.select(F.col("id").alias("_id"), F.col("first").alias("_first"))
        out = out.join(mapped, ["record", end], "left").withColumn("_id", F.coalesce("_own", end)).join(seen, "_id").where(F.col("_first") <= F.col("record"))
        out = out.withColumn(f"{end}_id", F.col("_id")).drop("_own", "_first", "_id")
    return out.select("record", "rid", "start_id", "end_id", "relation", "context")


def first_rows(relations: DataFrame, order: str = "rid", keys: tuple[str, ...] = ("start_id", "end_id", "relation", "context", "source")) -> DataFrame:
    """Of rows equal in ``keys`` (nulls are equal) the first by ``order``."""
    others = [c for c in relations.columns if c not in keys and c != order]
    firsts = relations.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("_f"))
    return firsts.select(*keys, "_f.*").select(*relations.columns)


def last_rows(entities: DataFrame, order: str = "record", key: str = "id") -> DataFrame:
    """Of each id the row of the greatest ``order``."""
    others = [c for c in entities.columns if c != key]
    return entities.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in others]).select(*entities.columns)


def from_headers(source: Column, context: Column) -> Column:
    """Whether a relation stems from headers: by its source or context; null says no."""
    return F.coalesce(F.lower(source).contains("header"), F.lit(False)) | F.coalesce(F.lower(context).contains("header metadata"), F.lit(False))


def classified(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``entities`` with ``origin``: ``Regex`` for mails and threads and for people of a header relation, else ``LLM``."""
    own = relations.where(from_headers(F.col("source"), F.col("context")))
    ids = own.select(F.col("start_id").alias("id")).union(own.select("end_id")).distinct().withColumn("_seen", F.lit(True))
    regex = F.col("type").isin("Email", "MailThread") | ((F.col("type") == "Person") & F.col("_seen").isNotNull())
    return entities.join(ids, "id", "left").withColumn("origin", F.when(regex, F.lit("Regex")).otherwise(F.lit("LLM"))).drop("_seen")


def extraction_report(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(part, origin, kind, n)``: entities by origin and type, relations by name, and both by origin."""
    e, r = classified(entities, relations), relations.withColumn("origin", F.when(from_headers(F.col("source"), F.col("context")), F.lit("Regex")).otherwise(F.lit("LLM")))
    none = F.lit(None).cast("string")
    parts = [
        e.groupBy(F.lit("entities").alias("part"), "origin", F.col("type").alias("kind")).agg(F.count("*").alias("n")),
        r.groupBy(F.lit("relations").alias("part"), none.alias("origin"), F.col("relation").alias("kind")).agg(F.count("*").alias("n")),
        r.groupBy(F.lit("relations by origin").alias("part"), "origin", none.alias("kind")).agg(F.count("*").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("part", F.desc("n"), "origin", "kind")


def extracted(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with ``entities`` and ``relations`` read from a model's answer; the answer itself stays for tracing."""
    return answers.withColumn("_read", model.graph_answer(F.col(answer))).withColumns({"entities": F.col("_read.entities"), "relations": F.col("_read.relations")}).drop("_read")


def schema_rate(triples: DataFrame, allowed: list[str], predicate: str = "predicate") -> DataFrame:
    """``(triples, predicates, on_schema, rate)``: how many predicates an ontology knows, of all rows; no rows have no rate."""
    known = F.col(predicate).isin(allowed)
    return triples.agg(F.count("*").alias("triples"), F.countDistinct(predicate).alias("predicates"), F.count_if(known).alias("on_schema"), F.try_divide(F.count_if(known), F.count("*")).alias("rate"))


def loose_triples(graph: Column) -> Column:
    """``array<struct<subject, predicate, object>>`` of relations in the shapes that schema-free extractors give.

    ``graph`` is JSON: a list, or an object with ``relations``; each relation a
    list of three or an object whose ends go by one of several names. Others are left out.
    """
    v = F.try_parse_json(graph)
    items = F.coalesce(F.try_variant_get(v, "$.relations", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))

    def get(x: Column, *paths: str) -> Column:
        return F.coalesce(*[text.blank_to_null(F.try_variant_get(x, p, "string")) for p in paths])

    def one(x: Column) -> Column:
        return F.struct(get(x, "$[0]", "$.subject", "$.start", "$.source").alias("subject"), get(x, "$[1]", "$.predicate", "$.relation", "$.edge").alias("predicate"), get(x, "$[2]", "$.object", "$.end", "$.target").alias("object"))

    return F.filter(F.transform(items, one), lambda t: t["subject"].isNotNull() & t["predicate"].isNotNull() & t["object"].isNotNull())


def person_context(people: DataFrame) -> DataFrame:
    """``(record, context)`` for a prompt: the people that a record's headers name, a line each, in order of place."""
    line = F.concat(F.lit("- "), F.col("id"), F.lit(": "), F.to_json("props"))
    lines = people.where("type = 'Person'").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    every = people.select("record").distinct().join(lines, "record", "left")
    head = F.lit("Persons already extracted from email headers (reuse these IDs):\n")
    return every.select("record", F.coalesce(F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")), F.lit("No persons in headers.")).alias("context"))
