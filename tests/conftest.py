from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reasonmill.session import ensure_checkpoint_dir, local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    ship_package(session)
    yield session
    session.stop()
