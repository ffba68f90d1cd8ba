import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wearcast.session import checkpoint_root, local_session

    s = local_session("*", 8)
    checkpoint_root(s)
    yield s


@pytest.fixture(scope="session")
def trained_small(spark):
    from wearcast.plans.queries import trained

    return trained(spark, SF001, "smoke")
