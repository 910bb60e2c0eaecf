import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidewake.session import local_session

    s = local_session(cores=8, name="tests", shuffle=8, spark__driver__memory="6g", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
