"""Every relational query against the SQL that says the same."""

import math

import duckdb
import pytest

from lumenq import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return str(v) if isinstance(v, list | dict) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in r] for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_oracle(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
