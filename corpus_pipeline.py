"""From raw documents to sharded training text in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``documents``; the last adds ``shard``. Stages pass
Parquet tables on shared storage, so a lost executor repeats one stage's tasks
at most. A null key is never another row's copy; stages 1, 3 and 4 treat rows
one by one, whatever their key. Every stage leaves an empty table empty, treats
repeated rows alike, keeps further columns whatever their names, and reads texts
of any length whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import table
from quillgraph.llm.decontaminate import drop_contaminated
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.quality import quality_filter
from quillgraph.llm.queries import MAX_EPOCHS, MIX_SEED, MIX_WEIGHTS, SHARDS
from quillgraph.llm.sharding import assign_shards
from quillgraph.llm.simhash import drop_near_duplicates
from quillgraph.sources.staging import drop_staged, stage, staged_so_far

#: SimHash groups and edit distance to benchmark items have no SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents outside the adaptive limits of their language and source, and those without a word."""
    return quality_filter(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows with a null key or without a word stay as well."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item; null texts and those without a word stay, as all do if the benchmark is empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the target weights of their sources.

    Null is a source like any other; a null or empty text adds nothing to its
    source's size, and a source of no size goes. Rows of one key share a draw.
    """
    return mix_sources(docs, MIX_WEIGHTS, MAX_EPOCHS, seed=MIX_SEED).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document; copies of one go to the same, and rows with null keys share one. A column ``shard`` is replaced."""
    return assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written within goes when it ends, and its input with it."""
    docs, since = table(spark, sf_dir, "documents"), staged_so_far()
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        drop_staged(since, keep=(docs,))
    return docs
