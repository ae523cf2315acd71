import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from profilespark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "8g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
