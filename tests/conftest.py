import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from floodlens.session import build_session, checkpoint_dir
    s = build_session("local[*]", 8, app="floodlens-tests")
    checkpoint_dir(s)  # tests set their own checkpoint folder (none is configured)
    yield s
    s.stop()
