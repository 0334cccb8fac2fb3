"""Every query of the engine against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from gleaner import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((cells(r) for r in frame.select(*columns).collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert got or name == "secret_scan"
        return
    sql = catalog.oracle_sql()[name]
    want = sorted((cells(r) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
