import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from probanza.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, app="tests")


@pytest.fixture
def frame(spark):
    """A text DataFrame from column names and rows."""

    def make(columns, rows):
        schema = ", ".join(f"`{c}` string" for c in columns.split())
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make
