"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    s = local_session("millrace-tests", cpus=4, partitions=4)
    yield s
    s.stop()
