"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from check import compare, duck

from evalgrid.plans import load_all

REG = load_all()


@pytest.fixture(scope="module")
def con():
    c = duck("sf0.001")
    yield c
    c.close()


@pytest.mark.parametrize("name", list(REG))
def test_matches_sql(spark, con, name):
    result, _, _ = compare(spark, con, name, REG[name], "sf0.001")
    assert result.startswith("ok" if REG[name].sql else "rows only"), result
