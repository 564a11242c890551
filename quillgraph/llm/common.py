"""Reading the driver tables and passing rows through Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_interval(hash64: Column) -> Column:
    """A 64-bit hash as a double strictly between 0 and 1 (its upper 53 bits)."""
    return (F.shiftrightunsigned(hash64, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, underscored until none clashes with a column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch, nulls as empty strings."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def order_key(df: DataFrame, key: str) -> Column:
    """A long that orders rows by ``key``: an integer itself, anything else by its hash; null comes last."""
    own = F.col(key).cast("long") if isinstance(df.schema[key].dataType, T.IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))
    return F.coalesce(own, F.lit((1 << 63) - 1))
