"""Every core query against its SQL, on whole tables."""

import pytest

from tests.compare import both
from twinlens import queries_analysis, queries_core, queries_study

QUERIES = queries_core.QUERIES | queries_analysis.QUERIES | queries_study.QUERIES
SQL = queries_core.SQL | queries_analysis.SQL | queries_study.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, QUERIES[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
