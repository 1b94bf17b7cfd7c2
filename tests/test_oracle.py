"""Every registered query with oracle SQL matches DuckDB at sf0.01 (the driver's rule)."""
import pytest

from tests.compare import compare, duck_connect
from shoal.plans.queries import ORACLE, QUERIES
from tests.conftest import SF01


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert ok, msg


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
