import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("STRANDWORK_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from strandwork.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "4")), 4, "tests", f"file://{tmp_path_factory.mktemp('checkpoints')}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
