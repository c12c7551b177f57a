"""Every graph query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftgraph.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    columns = sorted(df.columns)
    return sorted((tuple(value(v) for v in row) for row in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_vectors_have_unit_length(spark):
    rows = queries.document_embeddings(spark, DATA).collect()
    assert len(rows) == 200
    for r in rows[:20]:
        n = sum(float(x) ** 2 for x in r.vector.split(","))
        assert n == 0 or abs(n - 1) < 1e-2
