"""Reading delimited corpora and CSV tables, resuming, and writing graph tables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.sources.staging import small_enough, stage

#: Cell texts that stand for null where a reader infers nulls.
NULLS = ["", "NA", "N/A", "n/a", "None", "nan", "NaN", "null", "NULL", "<NA>", "#N/A", "NaT"]


def read_records(spark: SparkSession, path: str, end: str = "EMAIL_END") -> DataFrame:
    """``(record, text)`` of the records of text files, divided by a mark; blank ones go before numbering from 1.

    Spark splits the files itself at the mark, so a file larger than memory
    reads in parallel; numbers follow the order of files and places in them.
    """
    raw = spark.read.option("lineSep", end).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = raw.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"), "f", "b", "i").where("text <> ''")
    return numbered(rows, ["f", "b", "i"], "record").select("record", "text")


def split_at_headers(text: Column, header: str = "Thread ID:", end: str = "EMAIL_END") -> Column:
    """Records of a whole text that begin with a header line, whether or not a line end follows the mark."""
    repaired = F.regexp_replace(text, rf"{end}\s*{header}", f"{end}\n{header}")
    return F.filter(F.split(repaired, f"(?m)(?=^{header})"), lambda x: F.trim(x) != "")


def numbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """``df`` with its rank from 1 in ``order``, which must be total; of the rows equal in ``within``, where given.

    The sorted rows are written once, each with its partition and place; the
    counts of partitions are taken from what was written, so that both agree. No
    window over the whole table: no single task sees all rows, whatever the
    groups' sizes. Null is a group like any other.
    """
    within = within or []
    rows = df.orderBy(*within, *order).withColumn("_part", F.spark_partition_id())
    rows = stage(rows.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    counts = rows.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_w{i}" for i in range(len(within))]
    before = stage(counts.select(F.col("_part").alias("_p"), *[F.col(w).alias(n) for w, n in zip(within, names)], (earlier - F.col("_low") + 1).alias("_add")))
    side = F.broadcast(before) if small_enough(before, 100_000) else before
    on = [rows["_part"] == before["_p"], *[rows[w].eqNullSafe(before[n]) for w, n in zip(within, names)]]
    return rows.join(side, on).withColumn(name, F.col("_at") + F.col("_add")).select(*df.columns, name)


def read_csv(spark: SparkSession, path: str, schema: str, infer_nulls: bool = True) -> DataFrame:
    """A CSV table with a header and quoted cells of several lines; ``infer_nulls`` makes the usual words for it null."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema, emptyValue="", nullValue="\x00", enforceSchema=False)
    return df.select(*[(F.when(~F.col(c).isin(NULLS), F.col(c)) if infer_nulls else F.coalesce(c, F.lit(""))).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All CSV parts of a folder with the file each row is from; unreadable files are passed over."""
    return spark.read.option("ignoreCorruptFiles", "true").csv(f"{folder}/*.csv", header=True, multiLine=True, escape='"', schema=schema).select("*", F.col("_metadata.file_name").alias("file"))


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier output has."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_by_type(df: DataFrame, path: str, by: str) -> None:
    """One folder per type."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of CSV parts with headers in place of what was there; quotes are doubled and nulls are empty cells."""
    (df.coalesce(files) if files else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue='""', nullValue="")


def read_text(path: str) -> str:
    """A prompt or another small text of the driver."""
    return Path(path).read_text(encoding="utf-8")


def wipe_tables(spark: SparkSession, paths: list[str], dry_run: bool = True) -> dict[str, int]:
    """How many rows the tables below ``paths`` have; unless in a dry run each is replaced by one without rows, its schema kept."""
    out = {}
    for path in paths:
        df = spark.read.parquet(path)
        out[path] = df.count()
        if not dry_run:
            spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return out


def typed_view(nodes: DataFrame, label: str, properties: list[str]) -> DataFrame:
    """``(id, <properties>)`` of one label, missing ones empty; ``properties`` as the ontology names them."""
    return nodes.where(F.col("label") == label).select("id", *[F.coalesce(F.col("props")[k], F.lit("")).alias(k) for k in sorted(properties)])


class Ontology:
    """Node types with their properties and relations with their valid pairs of end types."""

    def __init__(self, nodes: Mapping[str, list[str]], relations: Mapping[str, list[tuple[str, str]]]):
        self.nodes = {k: list(v) for k, v in nodes.items()}
        self.relations = {k: [tuple(p) for p in v] for k, v in relations.items()}

    @classmethod
    def load(cls, path: str) -> Ontology:
        """From JSON: ``nodes{type: {properties}}`` and ``relationships{name: {type, valid_pairs}}``."""
        raw = json.loads(Path(path).read_text())
        return cls({k: v.get("properties", []) for k, v in raw["nodes"].items()}, {v.get("type", k): v.get("valid_pairs", []) for k, v in raw["relationships"].items()})

    def pairs(self, spark: SparkSession) -> DataFrame:
        rows = [(a, r, b) for r, ends in self.relations.items() for a, b in ends]
        return spark.createDataFrame(rows, "start_type string, relation string, end_type string")

    def properties(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v) for k, v in self.nodes.items()], "type string, allowed array<string>")

    def paths(self) -> list[str]:
        return [f"(:{a})-[:{r}]->(:{b})" for r, ends in self.relations.items() for a, b in ends]
