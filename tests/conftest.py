import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from webloom.session import local_session

    session = local_session("tests", cpus="4", **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()
