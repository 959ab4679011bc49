from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fluxlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"), "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2024, 1, 1)
STEP = timedelta(minutes=5)


@pytest.fixture(scope="session")
def series(spark):
    """A one-column series on a five-minute grid with positions: ``(ts, row_idx, x)``."""

    def build(values, **more):
        names = ["x", *more]
        rows = [(START + i * STEP, i, *[None if v is None else float(v) for v in row]) for i, row in enumerate(zip(values, *more.values()))]
        return spark.createDataFrame(rows, "ts timestamp_ntz, row_idx bigint, " + ", ".join(f"{n} double" for n in names))

    return build


@pytest.fixture(scope="session")
def column():
    """One column in time order, as a list."""

    def read(df, name, order="row_idx"):
        return [row[name] for row in df.orderBy(order).collect()]

    return read
