"""Every core query against its DuckDB counterpart."""

from __future__ import annotations

import pytest
from comparing import duck_rows, spark_rows

import __spark_entry__ as entry
from fieldspark import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, name):
    names, rows = spark_rows(catalog.queries()[name](spark, SF))
    assert (names, rows) == duck_rows(catalog.oracle_sql()[name], SF)


def test_registry_and_entry(spark):
    assert set(catalog.oracle_sql()) == set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
