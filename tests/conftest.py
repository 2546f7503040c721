import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TABWRIGHT_WORK_DIR", tempfile.mkdtemp(prefix="tabwright-test-"))
    from tabwright.session import local_session
    return local_session(8, "tabwright-tests")
