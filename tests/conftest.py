import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parents[1])
if REPO not in sys.path:
    sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.executorEnv.PYTHONPATH", REPO)
        .getOrCreate()
    )
    session.sparkContext.environment["PYTHONPATH"] = REPO
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
