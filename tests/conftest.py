import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pairlab.session import local_test_session

    root = str(tmp_path_factory.mktemp("spark"))
    s = local_test_session(root, cores=8)
    yield s
    s.stop()
