from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from clipweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiny_cells(spark):
    """Make every key with more than five rows a hot one."""
    spark.conf.set("clipweave.rowsPerCell", "5")
    yield
    spark.conf.unset("clipweave.rowsPerCell")


@pytest.fixture
def rows():
    def get(df, *cols):
        return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())

    return get
