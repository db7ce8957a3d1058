"""Every registered query against DuckDB on the smallest tables."""

import pytest

from tests.check_all import run_all
from tests.oracle import TESTDATA
from tracewell.plans import registry

NAMES = list(registry.queries())


@pytest.fixture(scope="module")
def results(spark):
    return {r[0]: r for r in run_all(spark, NAMES, f"{TESTDATA}/sf0.001")}


@pytest.mark.parametrize("name", NAMES)
def test_query(results, name):
    assert results[name][3] == ""


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(NAMES)
