import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from newslake.session import local_session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return local_session(cores=4, shuffle=4)
