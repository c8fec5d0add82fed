import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracefork.session import build_session

    session = build_session("8", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
