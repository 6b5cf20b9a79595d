"""KPSS statistics, orders and differences against plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest

from gridcast.operators import stationarity as st

SCHEMA = "name string, unique_id string, id_object int, ds timestamp_ntz, y double"


def made(seed=5):
    r = random.Random(seed)
    noise = [r.gauss(0, 1) for _ in range(260)]
    walk, twice, a, b = [], [], 0.0, 0.0
    for x in noise:
        a += x
        b += a
        walk.append(a)
        twice.append(b)
    return {"noise": noise, "walk": walk, "twice": twice, "flat": [3.0] * 50, "two": [1.0, 2.0], "one": [4.0], None: walk[:90]}


def slow_kpss(v):
    n = len(v)
    if n < 3:
        return None
    mean, lags = math.fsum(v) / n, math.floor(4 * (n / 100) ** 0.25)
    e = [x - mean for x in v]
    if not any(e):
        return 0.0
    s, total = 0.0, 0.0
    for x in e:
        s += x
        total += s * s
    var = sum(x * x for x in e) + 2 * sum((1 - j / (lags + 1)) * sum(a * b for a, b in zip(e[j:], e)) for j in range(1, lags + 1))
    return total / (n * var)


def diffs(v, d):
    for _ in range(d):
        v = [b - a for a, b in zip(v, v[1:])]
    return v


@pytest.mark.parametrize("chunk", [7, 64, 4096])
def test_statistics_against_plain_python(spark, chunk):
    # evenly spaced, so that no two rows share a stamp
    series = made()
    rows = [(k, "1", 6, datetime(2024, 1, 1) + timedelta(hours=i), v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["name"], r["order"]): r["statistic"] for r in st.kpss(df, chunk=chunk).collect()}
    for k, v in series.items():
        for d in range(3):
            own = diffs(v, d)
            if own:
                want = slow_kpss(own)
                assert got[k, d] == (None if want is None else pytest.approx(want, rel=1e-6, abs=1e-9)), (k, d)
            else:
                assert (k, d) not in got


def test_orders_and_differenced_series(spark):
    series = made()
    rows = [(k, "1", 6, datetime(2024, 1, 1) + timedelta(hours=i), v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA)
    orders = st.difference_order(df)
    got = {r["name"]: r["order"] for r in orders.collect()}
    assert got["noise"] == 0 and got["walk"] == 1 and got["flat"] == 0 and got["one"] == 0 and got["twice"] >= 1
    values = {}
    for r in st.difference_series(df, orders, chunk=16).orderBy("ds").collect():
        values.setdefault(r["name"], []).append(r["y"])
    for k, v in series.items():
        assert values[k] == pytest.approx(diffs(v, got[k]))


def test_null_values_and_no_rows(spark):
    df = spark.createDataFrame([("a", "1", 6, datetime(2024, 1, 1), None)], SCHEMA)
    assert st.difference_order(df).count() == 0 and st.difference_order(df.limit(0)).count() == 0
    with pytest.raises(KeyError):
        st.difference_order(df, significance=0.2)
