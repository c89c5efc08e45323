from __future__ import annotations

import pytest

from tests.oracle import same
from tidewright.plans import all_queries, all_sql


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_rows_equal_sql(spark, sf_dir, name):
    same(all_queries()[name](spark, sf_dir), all_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, sf_dir, name):
    assert all_queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
