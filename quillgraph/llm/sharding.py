"""Operator 1: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import unit_interval


def shard_of(keys: Sequence[Column], shards: Sequence[tuple[int, float]]) -> Column:
    """Shard id with the least ``-ln(u) / weight``, ``u`` a hash of (keys, shard id) in (0, 1).

    A shard's score depends on the record and that shard alone, so adding or
    removing one moves only the records that it wins or held, and the share of
    each shard is proportional to its weight.
    """
    usable = [(int(s), float(w)) for s, w in shards if w > 0]
    if not usable:
        raise ValueError("no shard has a positive weight")
    if len({s for s, _ in usable}) < len(usable):
        raise ValueError("a shard id is given twice")
    table = F.array(*[F.struct(F.lit(s).cast("long").alias("id"), F.lit(w).alias("w")) for s, w in usable])
    key = F.xxhash64(*keys)
    scored = F.transform(
        table,
        lambda s: F.struct((-F.ln(unit_interval(F.xxhash64(s["id"], key))) / s["w"]).alias("score"), s["id"].alias("id")),
    )
    return F.array_min(scored)["id"]


def assign_shards(records: DataFrame, shards: Sequence[tuple[int, float]], keys: Sequence[str] = ("doc_id",), out: str = "shard") -> DataFrame:
    """``records`` with the shard of each row; a narrow projection without shuffle.

    Rows with equal keys go to the same shard wherever they appear. A null key
    hashes like any other value, so all rows whose keys are null share one
    shard. Equal scores (a hash collision) go to the smaller shard id. A column
    already named ``out`` is replaced. An empty table stays empty.
    """
    return records.withColumn(out, shard_of([records[k] for k in keys], shards))


def write_shards(records: DataFrame, path: str, shards: Sequence[tuple[int, float]], keys: Sequence[str] = ("doc_id",), files: int = 1, out: str = "shard") -> None:
    """Write one folder per shard with ``files`` files each: one shuffle on (shard, salt)."""
    sharded = assign_shards(records, shards, keys, out)
    salt = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit("salt")), F.lit(files))
    sharded.repartition(max(1, len(shards) * files), F.col(out), salt).write.partitionBy(out).mode("overwrite").parquet(path)
