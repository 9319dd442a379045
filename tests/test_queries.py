import os, sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from compare import same
from sieveline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data), duck, registry.SQL[name])


SLOW = {"report_markdown", "train_types"}  # tested in test_training.py


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_query_runs(name, spark, data):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
