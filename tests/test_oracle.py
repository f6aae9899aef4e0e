"""Every registered query against its DuckDB oracle on the smallest scale.

The driver runs the same comparison at sf0.01 (``python tests/oracle_harness.py``
reproduces it locally).
"""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle_harness import compare

ORACLED = sorted(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "mapped_edge" in df.columns


def test_every_query_has_a_callable_and_most_an_oracle():
    qs = entry.queries()
    assert set(entry.oracle_sql()) <= set(qs)
    assert len(ORACLED) >= 70


@pytest.mark.parametrize("name", ORACLED)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF001, [name], verbose=False)[name]
    assert res[0] == "ok", res
