import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from repolens.plans.session import get_session

    session = get_session(master="local[4]", shuffle_partitions=8, app_name="repolens-tests",
                          checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
