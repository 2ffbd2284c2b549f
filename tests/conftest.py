import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_TINY = "/root/testdata/sf0.001"
SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wholesail.session import checkpoint_dir, local_session

    s = local_session(cores=4, app="wholesail-tests", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
