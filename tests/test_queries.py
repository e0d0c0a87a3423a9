"""Every query that has a SQL twin, on the smallest tables."""
import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import check

SQLS = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_as_sql(spark, con, sf, name):
    note, _, ok = check(spark, con, sf, name, queries()[name], SQLS[name])
    assert ok, note


def test_every_twin_has_a_query():
    assert set(SQLS) <= set(queries())
