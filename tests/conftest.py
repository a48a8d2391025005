import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cairnlake.runtime import local_session

    s = local_session("tests", cores="4", shuffle=4)
    yield s
    s.stop()
