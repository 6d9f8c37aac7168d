import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quayside.session import apply_runtime_conf, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    apply_runtime_conf(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def base():
    return SMALL
