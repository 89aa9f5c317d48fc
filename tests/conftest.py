import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strainspark.session import build_session

    folder = tempfile.mkdtemp(prefix="strainspark-test-")
    session = build_session("tests", master="local[4]", shuffle_partitions=4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.local.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
