import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tunelake.session import build_session, checkpoint_dir

    s = build_session(master="local[*]", shuffle_partitions=8, app="tunelake-tests")
    checkpoint_dir(s)  # unset in tests: a scratch folder is registered
    yield s
    s.stop()
