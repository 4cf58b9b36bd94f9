import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bourseflow.session import local
    s = local(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
