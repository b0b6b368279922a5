"""Every query against its SQL check."""

import pytest

import __spark_entry__ as contract
from tallyline.plans import catalog, oracles
from tests.compare import difference
from tests.conftest import FOLDER


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, FOLDER, name) is None


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
