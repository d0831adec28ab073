import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    """DuckDB over the small tables: sql -> (names, rows)."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")

    def run(sql):
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        return names, got.fetchall()

    return run


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame has the rows and columns of a query in SQL, in any order."""

    def key(row):
        return tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)

    def check(df, sql):
        names, rows = duck(sql)
        columns = sorted(df.columns)
        assert columns == sorted(names)
        at = [names.index(c) for c in columns]
        got = sorted(key([r[c] for c in columns]) for r in df.collect())
        assert got == sorted(key([r[i] for i in at]) for r in rows)

    return check
