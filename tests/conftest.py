import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from plumbline.runtime import local_session

    return local_session(cpus="8", partitions=8)
