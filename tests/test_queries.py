"""Every query of the core against its SQL on the smallest tables; those without SQL must run."""

import pytest

from flowquarry.plans import load_registry
from tests.oracle import compare

ENTRIES = load_registry().entries


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, folder, duck, name):
    e = ENTRIES[name]
    df = e.run(spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    if e.sql:
        assert compare(df, duck, e.sql) is None
    else:
        df.collect()
    spark.catalog.clearCache()


def test_entry_lists():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 3, 4, 6, 7):
        assert f"p{n}_found" in entry.queries()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).collect()
