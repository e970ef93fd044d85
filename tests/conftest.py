import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_session
    s = get_session("local[4]", app="cohortlens-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "8g",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cohortlens-test-ckpt-")})
    yield s
    s.stop()
