"""Every registered query of the engine against its SQL twin, on tables large enough to hold ties."""

import pytest

from tests.oracle import ROOT, compare
from tracewell.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_twin(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], "sf0.01")


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, f"{ROOT}/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
