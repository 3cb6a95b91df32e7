import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [_norm(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Checks that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(([_norm(x) for x in r] for r in df.select(*columns).collect()), key=str)
        want = duck.sql(sql)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(([_norm(r[i]) for i in at] for r in want.fetchall()), key=str)

    return check
