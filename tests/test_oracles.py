"""Every registered query of the core against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from scripts.verify import compare
from tests.conftest import SF
from tidemark.plans.catalog import catalog, coverage

CATALOG = catalog()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, duck, name):
    query, sql = CATALOG[name]
    same, n, _, _, diff = compare(spark, duck, name, query, sql, str(SF))
    assert same is not False, diff


def test_names_and_rows_are_registered():
    assert len(CATALOG) > 150
    assert all(rows for rows in coverage().values())


def test_columns_agree_with_oracles(spark, duck):
    for name, (query, sql) in CATALOG.items():
        if sql and name.startswith("p"):
            assert sorted(query(spark, str(SF)).columns) == sorted(duck.sql(sql).columns), name
