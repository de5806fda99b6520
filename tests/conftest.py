import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (ships the package to Python workers)
    from seqwright.session import build_session
    s = build_session("local[4]", partitions=8, extra={
        "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="seqwright-test-")})
    yield s
    s.stop()
