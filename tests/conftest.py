import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sparkdraft.session import build_session

    from sparkdraft.session import ensure_checkpoint_dir

    s = build_session(
        "local[4]",
        app_name="sparkdraft-tests",
        shuffle_partitions=8,
        extra_conf={"spark.driver.memory": "4g"},
    )
    # Uses spark.checkpoint.dir when the environment sets it; a temporary
    # folder only when it is unset.
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="sparkdraft-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
