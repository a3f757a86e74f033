"""Every registered query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from palisade.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return str(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in frame.collect())
    answer = duck.sql(ORACLES[name])
    assert sorted(answer.columns) == cols
    at = [answer.columns.index(c) for c in cols]
    assert got == sorted(tuple(canon(r[i]) for i in at) for r in answer.fetchall())
