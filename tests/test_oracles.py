"""Every catalogue query against DuckDB at sf 0.01: rows, column names and types."""

from __future__ import annotations

import pytest

from keelson.plans.catalogue import ORACLES, QUERIES

from .conftest import SF, duck_rows, rows

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
ROWS_ONLY = {"prototype_kmeans", "plane_coordinates", "neighbour_places"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in got.dtypes} == types
    assert rows(got) == duck_rows(duck, ORACLES[name])


def test_all_named():
    assert set(QUERIES) == set(ORACLES) | ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
