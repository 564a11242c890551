"""The whole way from messages to the entities and relations of a graph, by way of a model's answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import extraction as ex
from quillgraph.operators.resolution import registry
from quillgraph.providers import Extractor, extraction_prompts
from quillgraph.sources.staging import stage

#: Places of a record's own mentions begin here, after those of its headers.
_BODY = 1 << 20


def graph_rows(records: DataFrame, extractor: Extractor, system: str, prefixes: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, type, props)`` and ``(start_id, end_id, relation, context, source)`` of ``records(record, text)``.

    Ids of what headers name are given first, for all records at once, so that
    prompts can name them; answers are then asked for in parallel, and what they
    name anew is numbered after. Relations of an answer name its own entities or
    ids of the graph that appeared no later; others go, as do repeated rows. An
    entity has the properties of its last record. Header relations have the source
    ``header``, others the record's mail, or ``unknown``.
    """
    prefixes = ex.PREFIXES if prefixes is None else prefixes
    heads = ex.keyed(ex.header_mentions(records))
    known = stage(registry(heads, prefixes))
    heads = stage(heads.join(known, ["type", "key"]))
    bodies = records.select("record", text.body(F.col("text")).alias("body"))
    told = stage(ex.extracted(extractor.answers(extraction_prompts(bodies, heads, system))).withColumnRenamed("key", "record"))
    own = ex.keyed(told.select("record", F.posexplode("entities").alias("pos", "e")).select("record", (F.col("pos") + _BODY).alias("pos"), "e.type", F.col("e.properties").alias("props"), F.col("e.id").alias("temp_id")))
    fresh = own.join(known, ["type", "key"], "left_anti")
    taken = known.groupBy("type").agg(F.count("*").alias("n"))
    ids = known.unionByName(registry(fresh, prefixes, taken))
    own = stage(own.join(ids, ["type", "key"]))
    columns = ["record", "pos", "id", "type", "props"]
    every = heads.select(*columns).unionByName(own.select(*columns))
    rows = told.select("record", F.posexplode("relations").alias("pos", "r")).select("record", F.col("pos").alias("rid"), "r.start", "r.end", "r.relation", "r.context")
    firsts = every.groupBy("id").agg(F.min("record").alias("first"))
    mails = heads.where("type = 'Email' and role is null").groupBy("record").agg(F.min_by("id", "pos").alias("source"))
    found = ex.resolved_relations(rows, own.select("record", "temp_id", "id"), firsts).join(mails, "record", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))
    stated = ex.header_relations(heads).withColumn("rid", F.lit(-1))
    names = ["record", "rid", "start_id", "end_id", "relation", "context", "source"]
    relations = ex.first_rows(stated.select(*names).unionByName(found.select(*names)).withColumn("rid", F.struct("record", "rid")).drop("record"))
    return ex.last_rows(ex.once_per_record(every)).select("id", "type", "props"), relations.drop("rid")
