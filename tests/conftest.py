import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from braidwork.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest test tables."""
    return "/root/testdata/sf0.001"
