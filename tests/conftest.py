import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docmarket.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("docmarket-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of text ``t``."""

    def run(expr, text=None):
        return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]

    return run
