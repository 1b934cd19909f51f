import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ["PYTHONPATH"] = f"{Path(__file__).parents[1]}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from brindle.session import local_session

    top = tmp_path_factory.mktemp("spark")
    SparkSession.builder.config("spark.checkpoint.dir", f"file://{top}/shared").config("spark.sql.warehouse.dir", f"{top}/warehouse").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    session = local_session(8, 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not (DATA / "sf0.001").exists():
        pytest.skip("no test data")
    return str(DATA / "sf0.001")
