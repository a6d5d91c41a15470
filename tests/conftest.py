import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.session import local_session  # noqa: E402

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture(scope="session")
def folder():
    return DATA
