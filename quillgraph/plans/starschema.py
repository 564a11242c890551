"""The star-schema tables as a typed graph, and other inputs derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.corpus import Ontology

ONTOLOGY = Ontology(
    {
        "Region": ["name"],
        "Nation": ["name"],
        "Customer": ["name", "segment"],
        "Supplier": ["name"],
        "Order": ["status", "date", "priority"],
        "Part": ["name", "brand", "kind"],
    },
    {
        "inRegion": [("Nation", "Region")],
        "inNation": [("Customer", "Nation"), ("Supplier", "Nation")],
        "placed": [("Customer", "Order")],
        "contains": [("Order", "Part")],
        "suppliedBy": [("Part", "Supplier")],
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nodes(label, id, props)``; a filter on the label prunes the union to one table."""

    def one(name: str, label: str, prefix: str, key: str, props: dict[str, Column]) -> DataFrame:
        pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
        return table(spark, sf_dir, name).select(F.lit(label).alias("label"), _key(prefix, key).alias("id"), F.create_map(*pairs).alias("props"))

    out = one("region", "Region", "r", "r_regionkey", {"name": F.col("r_name")})
    for part in (
        one("nation", "Nation", "n", "n_nationkey", {"name": F.col("n_name")}),
        one("customer", "Customer", "c", "c_custkey", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}),
        one("supplier", "Supplier", "s", "s_suppkey", {"name": F.col("s_name")}),
        one("orders", "Order", "o", "o_orderkey", {"status": F.col("o_orderstatus"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": F.col("o_orderpriority")}),
        one("part", "Part", "p", "p_partkey", {"name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type")}),
    ):
        out = out.unionByName(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edges(start, type, end)``; a filter on the type prunes the union."""

    def one(name: str, kind: str, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
        return table(spark, sf_dir, name).select(_key(*a).alias("start"), F.lit(kind).alias("type"), _key(*b).alias("end"))

    out = one("nation", "inRegion", ("n", "n_nationkey"), ("r", "n_regionkey"))
    for part in (
        one("customer", "inNation", ("c", "c_custkey"), ("n", "c_nationkey")),
        one("supplier", "inNation", ("s", "s_suppkey"), ("n", "s_nationkey")),
        one("orders", "placed", ("c", "o_custkey"), ("o", "o_orderkey")),
        one("lineitem", "contains", ("o", "l_orderkey"), ("p", "l_partkey")),
        one("lineitem", "suppliedBy", ("p", "l_partkey"), ("s", "l_suppkey")),
    ):
        out = out.unionByName(part)
    return out
