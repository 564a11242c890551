import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sql():
    """Rows of a DuckDB query over the sf0.001 tables, as dictionaries."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def run(text: str, **frames) -> list[dict]:
        for name, frame in frames.items():
            con.register(name, frame)
        cur = con.execute(text)
        names = [c[0] for c in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    return run


def plain(value):
    """A value that compares alike from either engine."""
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if value is not None and not isinstance(value, (int, str)) else value


def same(spark_rows, sql_rows) -> bool:
    a = sorted((tuple(sorted((k, plain(v)) for k, v in r.asDict().items())) for r in spark_rows), key=repr)
    b = sorted((tuple(sorted((k, plain(v)) for k, v in r.items())) for r in sql_rows), key=repr)
    assert a == b, (a[:2], b[:2], len(a), len(b))
    return True
