import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chartloom.session import local_session, shared_folder

    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    shared_folder(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
