"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest

from lamella.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = oracle.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
