from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haulmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect a small frame as a list of tuples, sorted with NULLs last."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        data = [tuple(r) for r in picked.collect()]
        return sorted(data, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))

    return collect
