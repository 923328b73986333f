import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from markloom.session import local_session

    s = local_session("tests", cpus=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
