"""Every registered query against its SQL form; those without one must run and have a stable schema."""

import pytest

from millrace.plans import ORACLE_SQL, QUERIES
from tests.compare import same_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_twice_alike(spark, name):
    first, second = QUERIES[name](spark, SF), QUERIES[name](spark, SF)
    assert first.schema == second.schema
    assert first.count() == second.count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
