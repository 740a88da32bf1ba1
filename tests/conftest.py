import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tablewright.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(1, " Ann ", 30, 1000.0), (2, "Bob\t", 25, 2000.0), (3, "Cid", 35, 3000.0), (4, "Dee", 40, 4000.0),
         (5, "Eve", 28, 5000.0)], "id int, name string, age int, salary double")
