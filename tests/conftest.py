import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlight import build_session  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # A warehouse of its own: saved tables of an earlier run must not be in the way.
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
                            spark__ui__showConsoleProgress="false",
                            spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample():
    if not os.path.isdir(SAMPLE):
        pytest.skip("sample tables are not here")
    return SAMPLE


@pytest.fixture()
def one(spark):
    """Evaluates a column on a one-row frame of keyword columns."""
    from pyspark.sql import functions as F

    def value(column, schema=None, **cells):
        df = spark.range(1) if not cells else spark.createDataFrame([tuple(cells.values())], schema or list(cells))
        return df.select(column.alias("v")).first()["v"]

    assert F
    return value
