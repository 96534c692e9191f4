"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from lumenq.llm import queries


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table(got.columns, got.collect()) == table(names, want.fetchall())
