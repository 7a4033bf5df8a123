import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dishlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "6g", "tests")


@pytest.fixture
def rows():
    """Collected rows as a sorted list of plain tuples."""

    def collect(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
