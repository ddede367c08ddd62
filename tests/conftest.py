import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quern.session import get_spark

    os.environ.setdefault("QUERN_DRIVER_MEMORY", "4g")
    s = get_spark("tests", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)
