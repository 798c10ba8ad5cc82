"""Every registered query against its SQL twin, on the smallest tables."""

import re

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()

# Inventory ids the queries must reach between them.
INVENTORY = (
    [f"S{i}" for i in range(1, 16)]
    + [f"P{i}" for i in range(1, 17)] + ["P9b"]
    + [f"J{i}" for i in range(1, 9)]
    + [f"A{i}" for i in range(1, 26)]
    + [f"W{i}" for i in range(1, 4)]
    + [f"O{i}" for i in range(1, 10)]
    + [f"U{i}" for i in range(1, 7)]
    + [f"F{i}" for i in range(1, 28)] + ["F1b", "F7b"]
    + [f"T{i}" for i in range(1, 23)]
    + [f"E{i}" for i in range(1, 9)]
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = queries()[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(SQL[name]).df()) is None


def test_every_inventory_id_has_a_query():
    from quire.plans import REGISTRY

    covered = {item for q in REGISTRY.values() for item in q.covers}
    assert sorted(set(INVENTORY) - covered) == []


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry(spark)
    assert df.columns == ["year", "author", "count"]
    assert df.count() > 0


def test_twins_read_only_given_tables():
    for sql in SQL.values():
        assert not re.search(r"read_parquet|read_csv", sql)
