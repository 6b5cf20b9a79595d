import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridcast.session import forget_scratch, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="gridcast-tests")
    yield s
    forget_scratch(s)
    s.stop()


def series_df(spark, rows, name="a", uid="1", obj=6):
    """rows: list of (datetime, y) for one series."""
    return spark.createDataFrame(
        [(name, uid, obj, ts, float(y) if y is not None else None) for ts, y in rows],
        "name string, unique_id string, id_object int, ds timestamp_ntz, y double")


def hourly(start, values, step_hours=1):
    t0 = datetime.fromisoformat(start)
    return [(t0 + timedelta(hours=i * step_hours), v) for i, v in enumerate(values)]
