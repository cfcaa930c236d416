"""Every bar query with SQL gives DuckDB's rows on the driver's tables; the others run and have rows."""

from __future__ import annotations

import pytest

from barlake.plans import queries as plans
from tests.compare import close, of_duckdb, of_spark

SF = "/root/testdata/sf0.01"
SQL, ALL = plans.oracle_sql(), plans.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    names, ours = of_spark(ALL[name](spark, SF))
    expected, theirs = of_duckdb(SQL[name], SF)
    assert names == expected
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if not close(a, b)]
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    rows = ALL[name](spark, "/root/testdata/sf0.001").count()
    assert rows > 0 or name == "strategy_signals"  # a month of sparse bars need not hold a setup


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
