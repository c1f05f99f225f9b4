from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "driftlog-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunk borders every few rows, so carried values are exercised."""
    from driftlog.operators import ordered

    monkeypatch.setattr(ordered, "SEQ_CHUNK", 3)
    monkeypatch.setattr(ordered, "TIME_CHUNK_MS", 7)
