"""Tables written to the shared folder the cluster names in ``spark.checkpoint.dir``.

A staged table cuts lineage and survives the loss of any executor: its files
live on shared storage, so nothing downstream depends on an executor's disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` where set.

    Only a single-process session (``local`` or ``local[...]``) may go
    without it and then gets a temporary folder; a cluster without the setting
    is an error, because a machine-local folder would not be shared.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _fallback:
        folder = tempfile.TemporaryDirectory(prefix="quillgraph-")
        atexit.register(folder.cleanup)
        _fallback.append(folder.name)
    return f"file://{_fallback[0]}"


#: Tables staged and not yet dropped, oldest first, and the session that can drop them.
_staged: list[tuple[str, SparkSession]] = []


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under :func:`shared_dir` and return a reader of it.

    What isn't dropped by :func:`drop_staged` goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{uuid.uuid4().hex}"
    if not _staged:
        atexit.unregister(drop_staged)
        atexit.register(drop_staged)
    _staged.append((path, spark))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """How many staged tables there are; what is staged later can be dropped from here on."""
    return len(_staged)


def drop_staged(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables staged after ``since``, except those that ``keep`` reads. No other frame may read them any more."""
    files = [f for df in keep for f in df.inputFiles()]
    left = []
    for path, spark in _staged[since:]:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files):
            left.append((path, spark))
            continue
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the driver's other half has ended; its cluster cleans the folder
            return
    _staged[since:] = left


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (best a staged table) has at most ``rows`` rows.

    A count reads no columns and adds up per task; a limit would send up to
    ``rows`` rows of every partition to one task.
    """
    return df.count() <= rows
