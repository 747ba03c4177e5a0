import datetime
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from daymart.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make_series(spark):
    """Entity-day rows from lists of values on consecutive days; 'skip' leaves a day out."""

    def make(series: dict, start: str = "2024-01-01", value: str = "v"):
        rows = [
            (name, day(start) + datetime.timedelta(days=i), v)
            for name, values in series.items()
            for i, v in enumerate(values)
            if v != "skip"
        ]
        return spark.createDataFrame(rows, f"country string, d date, {value} double")

    return make
