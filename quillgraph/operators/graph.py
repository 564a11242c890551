"""Graph tables: cleaning by an ontology, upserts, and pattern queries compiled to joins.

``nodes(label, id, props map<string,string>)`` and ``edges(start, type, end, ...)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.corpus import Ontology


def whitelisted(props: Column, allowed: Column) -> Column:
    """Properties with allowed names; null or no properties give an empty map."""
    return F.coalesce(F.map_filter(props, lambda k, v: F.array_contains(allowed, k)), F.create_map().cast("map<string,string>"))


def parse_properties(text: Column) -> Column:
    """A JSON object as a map of texts; anything else is empty."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def clean_nodes(entities: DataFrame, ontology: Ontology) -> DataFrame:
    """``(id, type, props)`` of known types, with known properties."""
    known = F.broadcast(ontology.properties(entities.sparkSession))
    return entities.join(known, "type").select("id", "type", whitelisted(F.col("props"), F.col("allowed")).alias("props"))


def clean_edges(relations: DataFrame, entities: DataFrame, ontology: Ontology) -> DataFrame:
    """Relations between known entities whose types are a valid pair.

    Of an id with several types the last by ``rid`` counts, or the greatest where there is no ``rid``.
    """
    kinds = entities.groupBy("id").agg((F.max_by("type", "rid") if "rid" in entities.columns else F.max("type")).alias("type"))
    out = relations.join(kinds.select(F.col("id").alias("start"), F.col("type").alias("start_type")), "start").join(kinds.select(F.col("id").alias("end"), F.col("type").alias("end_type")), "end")
    return out.join(F.broadcast(ontology.pairs(relations.sparkSession)), ["start_type", "relation", "end_type"], "left_semi").select(*relations.columns)


def upsert_nodes(rows: DataFrame, order: str, properties: list[str]) -> DataFrame:
    """One node per (label, id); each property has its last value that isn't null, in the order of rows. Null ids are skipped."""
    last = [F.max_by(F.when(F.col(p).isNotNull(), F.col(p)), F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties]
    return rows.where("id is not null").groupBy("label", "id").agg(*last)


def upsert_edges(rows: DataFrame, nodes: DataFrame, order: str, properties: list[str]) -> DataFrame:
    """One edge per (start, type, end) between existing nodes, with the last values that aren't null; others are dropped."""
    ids = nodes.select("id").distinct()
    there = rows.join(ids.withColumnRenamed("id", "start"), "start", "left_semi").join(ids.withColumnRenamed("id", "end"), "end", "left_semi")
    last = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties]
    return there.groupBy("start", "type", "end").agg(*last)


def schema_text(nodes: DataFrame) -> DataFrame:
    """``(label, properties)``: the property names of each label, in order."""
    return nodes.select("label", F.explode(F.map_keys("props")).alias("k")).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("k")), ", ").alias("properties"))


def unconnected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(type, n)`` of entities in no relation."""
    ends = relations.select(F.col("start").alias("id")).union(relations.select(F.col("end").alias("id"))).where("id is not null").distinct()
    return entities.join(ends, "id", "left_anti").groupBy("type").agg(F.count("*").alias("n"))


def connected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities in a relation, ids compared without blanks around them."""
    ends = relations.select(F.trim("start").alias("id_")).union(relations.select(F.trim("end").alias("id_")))
    return entities.join(ends, F.trim("id") == F.col("id_"), "left_semi")


@dataclass(frozen=True)
class Node:
    """A node of one label or of any of several (``Method|Dataset``)."""

    var: str
    label: str
    props: tuple[str, ...] = ()

    @property
    def labels(self) -> list[str]:
        return self.label.split("|")


@dataclass(frozen=True)
class Hop:
    """An edge of one of ``types`` to ``to``: ``>`` from the node before, ``<`` to it, ``-`` either way."""

    types: tuple[str, ...]
    to: Node
    direction: str = ">"


@dataclass(frozen=True)
class Pattern:
    start: Node
    hops: tuple[Hop, ...] = ()
    forbidden: frozenset[str] = field(default_factory=frozenset)

    def nodes(self) -> list[Node]:
        return [self.start, *[h.to for h in self.hops]]

    def problems(self, ontology: Ontology) -> list[str]:
        """What of the pattern the ontology doesn't have; every hop and every type of it is checked, and one pair of labels must fit."""
        each = [(n, label) for n in self.nodes() for label in n.labels]
        out = [f"unknown label {label}" for _, label in each if label not in ontology.nodes]
        out += [f"forbidden label {label}" for _, label in each if label in self.forbidden]
        out += [f"{label} has no property {p}" for n, label in each for p in n.props if p not in ontology.nodes.get(label, [])]
        at = self.start
        for h in self.hops:
            for t in h.types:
                pairs = ontology.relations.get(t, [])
                ends = [(a, b) for a in at.labels for b in h.to.labels]
                ahead, back = any((a, b) in pairs for a, b in ends), any((b, a) in pairs for a, b in ends)
                if not {">": ahead, "<": back, "-": ahead or back}[h.direction]:
                    out.append(f"({at.label}){h.direction}[{t}]({h.to.label}) is no valid pair")
            at = h.to
        return out

    def match(self, nodes: DataFrame, edges: DataFrame, ontology: Ontology | None = None) -> DataFrame:
        """One row per match with ``<var>_id`` and ``<var>_<property>``; a chain of equi-joins that Catalyst orders.

        Edges of labelled tables prune by label and type before they join. Two
        nodes of one variable are the same node.
        """
        if ontology and (wrong := self.problems(ontology)):
            raise ValueError("; ".join(wrong))

        def side(n: Node) -> DataFrame:
            return nodes.where(F.col("label").isin(*n.labels)).select(F.col("id").alias(f"{n.var}_id"), *[F.col("props")[p].alias(f"{n.var}_{p}") for p in n.props])

        out, seen, at = side(self.start), {self.start.var}, self.start
        for h in self.hops:
            own = edges.where(F.col("type").isin(*h.types)).select("start", "end")
            ahead = own.select(F.col("start").alias(f"{at.var}_id"), F.col("end").alias(f"{h.to.var}_id"))
            back = own.select(F.col("end").alias(f"{at.var}_id"), F.col("start").alias(f"{h.to.var}_id"))
            step = ahead if h.direction == ">" else back if h.direction == "<" else ahead.union(back)
            if h.to.var in seen:
                out = out.join(step, [f"{at.var}_id", f"{h.to.var}_id"])
            else:
                out = out.join(step, f"{at.var}_id").join(side(h.to), f"{h.to.var}_id")
                seen.add(h.to.var)
            at = h.to
        return out


def contains(text: Column, part: str) -> Column:
    """Whether a text holds another, in any case."""
    return F.lower(text).contains(part.lower())


def as_date(text: Column) -> Column:
    """ISO text as a date; a partial or false date is null."""
    return F.try_to_date(text, "yyyy-MM-dd")


def any_match(matches: DataFrame, column: str) -> DataFrame:
    """One row: whether any match has a value."""
    return matches.agg((F.count(column) > 0).alias("result"))
