"""Registered timeline queries against their SQL in DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tideframe.plans import registry

SF = os.environ.get("TIDEFRAME_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    say = lambda x: "null" if pd.isna(x) else f"{float(x) + 0.0:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(say, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_library_stands_alone():
    code = "import sys, tideframe.plans.registry, tideframe.sources.sessions, tideframe.streaming.live; assert not any(m.startswith('tideframe.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
