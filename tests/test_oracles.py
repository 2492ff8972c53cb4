"""Every query that SQL states gives SQL's rows, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from pagewright.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else str(v).removesuffix(".0") for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    """Queries without SQL have rows, and one for each page where that is what they give."""
    rows = QUERIES[name](spark, SF).count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert rows == pages if name in ("page_markdown", "page_metadata", "page_report") else rows > 0
