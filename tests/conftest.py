import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="tidemark-test-")
    session = build_session(
        "tests", "local[8]", spark__checkpoint__dir=root, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


def rows(df, *cols):
    """Rows as sorted tuples, None first."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda t: [(v is not None, v) for v in t])
