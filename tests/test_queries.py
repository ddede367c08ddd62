"""Every query of the core against DuckDB on the smallest data."""

import os

import pytest
from compare import connect, difference

from quern.plans import registry

SF = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE:
        assert difference(spark, SF, name, registry.QUERIES[name], registry.ORACLE[name], con).removesuffix("no rows on either side") in ("", f"{name}: ")
    else:
        df = registry.QUERIES[name](spark, SF)
        assert len(set(df.columns)) == len(df.columns) and df.count() > 0
