import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, shared_dir, ship

    s = local_session(4, 4)
    shared_dir(s)
    ship(s)
    yield s
    s.stop()
