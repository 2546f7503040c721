"""Registered queries against their SQL counterparts on the smallest tables."""

import __spark_entry__ as entry
import pytest
from check import difference, oracle_frame

FOLDER = "/root/testdata/sf0.001"
# fits of full size take minutes on any table; `python tests/check.py m04 ...` runs them
SLOW = {"boosted_fit_m04", "model_comparison_m06", "recursive_elimination_m07", "train_on_synthetic_m09", "boruta_d05", "permutation_importance_d06"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, oracle_frame(entry.oracle_sql()[name], FOLDER)) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert sum(r["n"] for r in entry.entry(spark).collect()) > 0
