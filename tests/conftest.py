import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tieline.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
