import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritab.session import build_session  # noqa: E402

DATA = os.environ.get("VERITAB_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.default.parallelism": "8"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def ten(spark):
    """The ten-row frame with two missing cells."""
    # The cells of the frame.
    numeric = [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0, 8.0, 9.0, 10.0]
    mixed = [1.1, 2.2, None, 4.4, 5.5, 6.6, 7.7, 8.8, 9.9, 10.0]
    rows = list(zip(range(10), numeric, "ABACBACABC", mixed))
    return spark.createDataFrame(
        rows, "id int, numeric_col double, categorical_col string, mixed_col double").drop("id")
