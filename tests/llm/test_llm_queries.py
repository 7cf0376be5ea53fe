"""Every query of the subpackage: against its SQL where there is one, else that it runs over the whole tables."""

import pytest

from tests.compare import both
from twinlens.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, Q.QUERIES[name], Q.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0
