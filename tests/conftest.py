import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from batchtrace.session import get_spark
    s = get_spark("local[4]", 4, app_name="batchtrace-tests",
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bt-test-ckpt-")})
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
