import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quillveil.session import get_session, release_scratch

    session = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
