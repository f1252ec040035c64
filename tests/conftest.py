import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from vetloom.session import get_spark

    s = get_spark("tests", cores=4, shuffle=4)
    yield s
    s.stop()
