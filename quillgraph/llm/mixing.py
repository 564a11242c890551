"""Operator 5: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm.common import free_name, unit_interval
from quillgraph.sources.staging import small_enough, stage


def source_epochs(sizes: DataFrame, weights: Mapping[str, float], max_epochs: float, total: float | None = None, default_weight: float = 1.0) -> DataFrame:
    """``(source, size, epochs)`` from ``(source, size)``.

    The budget (``total``, or else the sum of sizes) is shared in proportion to
    the weights. A source whose share is above ``max_epochs`` times its size is
    clamped there and the excess goes to the others in proportion to their
    weights, again and again until no share is above its limit. The fixed point
    has a closed form: with sources in the order of limit / weight, those up to
    the water level are clamped. A budget above all limits clamps every source.
    A weight of 0 or a size of 0 gives 0 epochs.
    """
    spark = sizes.sparkSession
    given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], T.StructType([T.StructField("name", T.StringType()), T.StructField("w", T.DoubleType())]))
    s = sizes.join(F.broadcast(given), sizes.source.eqNullSafe(given.name), "left").select("source", F.col("size").cast("double").alias("size"), F.coalesce("w", F.lit(float(default_weight))).alias("w"))
    budget = s.agg(F.coalesce(F.lit(total), F.sum("size")).alias("budget"))
    s = s.withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    live = s.where("w > 0 and size > 0").crossJoin(budget).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_first())
    live = (
        live.withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_from", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.coalesce("cap_before", F.lit(0.0))) / F.col("w_from"))
        .withColumn("level", F.max(F.when(F.col("r") > F.col("level"), F.col("level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    shares = live.select("source", "size", (F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))) / F.col("size")).alias("epochs"))
    return shares.unionByName(s.where("not (w > 0 and size > 0)").select("source", "size", F.lit(0.0).alias("epochs")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    max_epochs: float = 4.0,
    total: float | None = None,
    default_weight: float = 1.0,
    seed: int = 17,
    size: Column | None = None,
    key: str = "doc_id",
    broadcast_rows: int = 200_000,
    epoch: str = "epoch",
) -> DataFrame:
    """Rows of ``docs`` repeated so that sources reach their target weights; ``epoch`` numbers the copies from 1.

    Each row is given whole repetitions and, with the probability of the
    remaining fraction, one more, drawn by a seeded hash of (key, seed): the
    same rows in any run and for any partitioning. ``size`` is the amount that
    weights refer to, by default the characters of ``text`` (null: 0). Sources
    without a weight get ``default_weight``; null is a source like any other,
    and rows with a null key share one draw. Repeated rows are drawn alike. A
    source of size 0 and an empty table give no rows. The text isn't shuffled:
    shares of up to ``broadcast_rows`` sources are broadcast, more are joined.
    """
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    share, reps, name = free_name(docs, "share", "reps", "share_source")
    sizes = docs.select(F.col("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    epochs = stage(source_epochs(sizes, weights, max_epochs, total, default_weight).select(F.col("source").alias(name), F.col("epochs").alias(share)))
    side = F.broadcast(epochs) if small_enough(epochs, broadcast_rows) else epochs
    draw = unit_interval(F.xxhash64(F.lit(seed).cast("long"), F.col(key)))
    whole = F.floor(F.col(share))
    out = docs.join(side, docs["source"].eqNullSafe(epochs[name]))
    out = out.withColumn(reps, (whole + F.when(draw < F.col(share) - whole, 1).otherwise(0)).cast("int"))
    keep = [F.col(c) for c in docs.columns if c.lower() != epoch.lower()]
    return out.where(F.col(reps) > 0).select(*keep, F.explode(F.sequence(F.lit(1), F.col(reps))).alias(epoch))
