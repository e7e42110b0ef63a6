import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.spec import canonical_schema  # noqa: E402
from signal_rows import beat_rows, pad  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "6g")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def five_classes(spark):
    """60 / 20 / 12 / 4 / 4 signals; every fifth one is in the test split."""
    rows = []
    for label, n in enumerate([60, 20, 12, 4, 4]):
        for i in range(n):
            length = 20 + 10 * label + i % 5
            plateau = 0.2 + 0.1 * label + 0.001 * i
            samples = [1.0] + [plateau] * (length - 2) + [0.5]
            rows.append((f"{label}-{i}", "test" if i % 5 == 0 else "train", label, pad(samples)))
    return spark.createDataFrame(beat_rows(rows), canonical_schema()).cache()
