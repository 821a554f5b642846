"""Every core query with SQL against that SQL, over the whole smallest tables."""

from pathlib import Path

import pytest
from oracle import compare

from graphloom import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal(spark, name):
    assert compare(spark, FOLDER, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
