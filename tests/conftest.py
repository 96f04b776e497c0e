from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chalkline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """The value of one expression over one row of named columns."""
    from pyspark.sql import functions as F

    def run(expression, schema: str | None = None, **columns):
        row = spark.createDataFrame([tuple(columns.values())], schema or list(columns))
        return row.select(expression(*[F.col(name) for name in columns]).alias("out")).first()["out"]

    return run
