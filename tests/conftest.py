import glob
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(rows):
    """Rows as sorted tuples of strings, floats rounded, for comparison."""

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        if isinstance(x, float):
            return repr(round(x, 9))
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Assert that a DataFrame and a SQL query have equal rows."""

    def check(df, sql):
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        names = sorted(df.columns)
        got = canonical(df.select(*[f"`{c}`" for c in names]).toPandas().astype(object).where(lambda p: p.notna(), None).values.tolist())
        want = canonical(duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").df().astype(object).where(lambda p: p.notna(), None).values.tolist())
        assert got == want

    return check


@pytest.fixture(scope="session")
def sf():
    return SF
