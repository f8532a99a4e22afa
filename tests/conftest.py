import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from eligo.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
        "spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    s = build_session("tests", master="local[8]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
