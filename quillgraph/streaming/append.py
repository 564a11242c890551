"""Appending results as records arrive, each record once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillgraph.sources.corpus import unprocessed


def append_stream(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Writes ``transform`` of each micro-batch to a folder of its own below ``path``, which must keep ``key``.

    A key is written once: rows whose key an earlier batch has written, and all
    but one row of a key within a batch, are left out. A batch that is run again
    overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            before = batch.sparkSession.read.parquet(path).where(f"batch <> {number}")
        except AnalysisException:  # nothing was written yet
            before = None
        rows = rows if before is None else unprocessed(rows, before, key)
        transform(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
