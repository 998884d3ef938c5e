import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from codeweave.session import local_session
    return local_session(shuffle_partitions=8, app="codeweave-tests")


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (never cleared, never reused)."""
    return tempfile.mkdtemp(prefix="cw-test-", dir="/tmp")
