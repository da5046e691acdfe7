"""Every core query that has an SQL twin agrees with it on the smallest tables; the others run."""

import oracle
import pytest

from framelode.plans import catalogue

CORE = catalogue()


@pytest.mark.parametrize("name", sorted(CORE.queries))
def test_query(name, spark, sf, con):
    df = CORE.queries[name](spark, sf)
    if name in CORE.sql:
        assert oracle.compare(df, con, CORE.sql[name]) is None
    else:
        assert df.columns and df.count() >= 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(CORE.queries) <= set(e.queries())
