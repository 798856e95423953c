"""Every registered query against its DuckDB oracle (small scale factor)."""

import pytest

from oracle_compare import compare, duck
from supplylens.plans import registry
from conftest import SF_SMALL

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    qs, sql = registry.queries(), registry.oracle_sql()
    res = compare(spark, con, name, qs[name], sql.get(name), sf_dir)
    assert res["status"] in ("ok", "rows-only"), res


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
