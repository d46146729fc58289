import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from parlance.session import get_session
    scratch = tempfile.mkdtemp(prefix="parlance-test-")
    s = get_session("local[4]", shuffle_partitions=4, app_name="parlance-tests",
                    extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                           "spark.driver.memory": "4g"})
    yield s
    s.stop()
