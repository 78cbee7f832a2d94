import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from wardline.session import local_session

    s = local_session(4, 4, "tests")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    yield s
    s.stop()
