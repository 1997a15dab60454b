"""Every registered query against its SQL, value for value, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from leafmill.plans.queries import ORACLES, QUERIES


def rows(columns, data):
    show = lambda v: "∅" if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_most_queries_have_sql():
    assert len(ORACLES) >= 0.9 * len(QUERIES)
