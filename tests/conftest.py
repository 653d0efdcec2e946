import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwarden.plans.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "6g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tabwarden-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
