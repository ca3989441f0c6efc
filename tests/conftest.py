"""One small session for all tests, and the tables' folder."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from quarryline import session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.local_session("4", 4)
    session.share_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
