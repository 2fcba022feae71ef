"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pipegrid import get_spark, ship

    session = get_spark(8, "tests")
    ship(session)
    yield session
    session.stop()
