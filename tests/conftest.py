import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    yield s
    s.stop()


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


PANEL = "id long, mi int, price double, mcap double, ret double, exch string"


@pytest.fixture
def panel(make):
    """Rows (id, mi, ret[, mcap[, exch]]) to a panel."""

    def build(rows):
        full = [(r[0], r[1], 1.0, r[3] if len(r) > 3 else 1.0, r[2], r[4] if len(r) > 4 else "N") for r in rows]
        return make(full, PANEL)

    return build
