"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import sql
from quillgraph.llm.common import table
from quillgraph.llm.decontaminate import contaminated
from quillgraph.llm.lines import drop_repeated_lines
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.passages import drop_repeated_passages
from quillgraph.llm.pii import personal_data
from quillgraph.llm.quality import quality_filter
from quillgraph.llm.sharding import assign_shards
from quillgraph.llm.simhash import near_duplicates
from quillgraph.llm.tokens import count_tokens
from quillgraph.llm.urls import filter_urls

#: Shard id and weight: four large machines among twelve small ones.
SHARDS: list[tuple[int, float]] = [(i, 2.0 if i >= 12 else 1.0) for i in range(16)]
#: Weight of each source in the mix; others count 1.
MIX_WEIGHTS: dict[str, float] = {"src0": 4.0, "src1": 6.0, "src2": 3.0, "src3": 0.5, "src4": 0.25}
MAX_EPOCHS = 2.0
MIX_SEED = 17
#: Least number of bad URLs of a rule, and least share of its URLs that are bad.
URL_SUPPORT, URL_CONFIDENCE = 5, 0.6
#: Rank file of the tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is a near copy, with the one that is kept for it."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the labelled pages; bad ones are of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id").select("url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages with the mined rule that rejects their URL, if one does."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark, sf_dir), URL_SUPPORT, URL_CONFIDENCE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of lines and runs of lines of 40 bytes or more."""
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights, one row per copy."""
    return mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MAX_EPOCHS, seed=MIX_SEED)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within the adaptive limits of their language and source."""
    return quality_filter(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its edits."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data in the documents."""
    return personal_data(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose passages of 50 words or more that occurred before, with what is left of them."""
    return drop_repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).select("doc_id", "n_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_sharding, op2_near_duplicates, op3_url_filter, op4_line_dedup, op5_mixing, op6_quality, op7_decontamination, op8_personal_data, op9_passages, op10_token_counts]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sql.sharding("documents", SHARDS),
        "op4_line_dedup": sql.line_dedup("documents"),
        "op5_mixing": sql.mixing("documents", MIX_WEIGHTS, MAX_EPOCHS, MIX_SEED),
        "op6_quality": sql.quality("documents"),
        "op9_passages": sql.passages("documents"),
    }
