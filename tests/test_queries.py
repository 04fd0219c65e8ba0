"""Every registered query of the library against its SQL on the small tables."""

import pytest
from oracle import connect, differences

from skein.queries import catalog
from skein.queries.vectors import FAMILIES, measured

CATALOG = catalog()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_same_rows_as_sql(name, spark, sf, con):
    run, sql = CATALOG[name]
    assert differences(run(spark, sf), con, sql) == ""


@pytest.mark.parametrize("family", FAMILIES)
def test_recall(family, spark, sf):
    """Over every id that 20 divides; half of the lists let little more than half of the rows pass."""
    recall, share = measured(spark, sf, family)
    assert recall >= 0.9 and (not family.startswith("ivf") or share < 0.65)


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(CATALOG) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
