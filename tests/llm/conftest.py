import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import ODD_ROWS, TEXTS  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, TEXTS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], TEXTS)


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no data folder")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").toPandas()


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
