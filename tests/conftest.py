from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.default.parallelism", "4").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def canonical(value):
    """Values as they compare between Spark and DuckDB."""
    import math

    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(float(value)) else float(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        ours = sorted(repr(tuple(canonical(r[c]) for c in columns)) for r in df.collect())
        relation = con.sql(sql)
        names = relation.columns
        assert sorted(names) == columns
        theirs = sorted(repr(tuple(canonical(r[names.index(c)]) for c in columns)) for r in relation.fetchall())
        assert ours == theirs

    return check
