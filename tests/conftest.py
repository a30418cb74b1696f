import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumenaudit.session import local_session  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lumenaudit-tests-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = os.path.join(TESTDATA, "sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
