import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.checkpoint.dir", f"{shared}/shared")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compares a query with its SQL in DuckDB over the same tables."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")

    def plain(x):
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    def key(row):
        return tuple((x is None, str(type(x)), str(x)) if not isinstance(x, (int, float)) else (False, "", f"{x:+030.6f}") for x in row)

    def compare(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
        rel = con.sql(sql)
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        expected = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=key)
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-5 * max(1, abs(x))), (a, b)

    return compare
