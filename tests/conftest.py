import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from panelweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "panelweave-tests")


@pytest.fixture(scope="session")
def series(spark):
    """Builds (ticker, date, value) frames from lists; None leaves the day out."""
    def make(data, value="ret", key="ticker", start=dt.date(2020, 1, 1)):
        rows = [(k, start + dt.timedelta(i), float(x)) for k, xs in data.items() for i, x in enumerate(xs) if x is not None]
        return spark.createDataFrame(rows, f"{key} string, date date, {value} double")
    return make
