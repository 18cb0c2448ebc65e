"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same check at sf0.01); rows-only keys must run and return rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.helpers import duck_bag, spark_bag

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN",
          "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP", "DoubleType()": "DOUBLE"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, small_dir, key):
    df = QUERIES[key](spark, small_dir)
    cols, rows = spark_bag(df)
    ocols, orows = duck_bag(duck, ORACLES[key])
    assert cols == ocols
    spark_types = {f.name: _TYPES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLES[key]}").fetchall()}
    assert spark_types == duck_types
    assert len(rows) == len(orows)
    assert rows == orows


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, small_dir, key):
    assert QUERIES[key](spark, small_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == entry.entry(spark).columns
