import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tessera.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(cores=os.environ.get("TEST_CPUS", "4"), partitions=4))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
