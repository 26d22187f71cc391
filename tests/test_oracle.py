"""Every registered query against its DuckDB oracle (sf0.001), and the driver contract."""

import pytest

from tests.conftest import SF001
from tests.oracle_check import compare, duck
from txguard.plans.registry import load_all

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(REG))
def test_matches_oracle(spark, con, name):
    q = REG[name]
    got = q.run(spark, SF001).toPandas()
    exp = con.sql(q.oracle()).df()
    assert compare(got, exp) is None


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
