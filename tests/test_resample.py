from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, hourly, series_df
from gridcast.operators.resample import resample
from gridcast.plans import registry

D = datetime.fromisoformat


def rows(df):
    return sorted((r.ds, r.y) for r in df.collect())


@pytest.mark.parametrize("method", ["window", "join"])
def test_gap_fill(spark, method):
    obs = series_df(spark, [(D("2020-06-24 01:00"), 5.0), (D("2020-06-24 02:00"), 6.0),
                            (D("2020-06-24 05:00"), 7.0)])
    out = rows(resample(obs, "one_hour", to_date="2020-06-24 07:00:00", method=method))
    assert len(out) == 7
    assert [y for _, y in out] == [5.0, 6.0, 0.1, 0.1, 7.0, 0.1, 0.1]


@pytest.mark.parametrize("method", ["window", "join"])
def test_off_grid_drop_and_keep(spark, method):
    obs = series_df(spark, [(D("2020-06-24 01:00"), 1.0), (D("2020-06-24 02:30"), 9.0),
                            (D("2020-06-24 03:00"), 3.0)])
    dropped = rows(resample(obs, "one_hour", method=method))
    assert dropped == [(D("2020-06-24 01:00"), 1.0), (D("2020-06-24 02:00"), 0.1),
                       (D("2020-06-24 03:00"), 3.0)]
    kept = resample(obs, "one_hour", off_grid="keep", method=method).collect()
    off = [r for r in kept if not r.on_grid]
    assert len(kept) == 4 and len(off) == 1 and off[0].ds is None and off[0].y == 9.0


@pytest.mark.parametrize("method", ["window", "join"])
def test_duplicate_ticks_fan_out(spark, method):
    obs = series_df(spark, [(D("2020-06-24 01:00"), 1.0), (D("2020-06-24 01:00"), 2.0),
                            (D("2020-06-24 03:00"), 3.0)])
    out = rows(resample(obs, "one_hour", method=method))
    assert out == [(D("2020-06-24 01:00"), 1.0), (D("2020-06-24 01:00"), 2.0),
                   (D("2020-06-24 02:00"), 0.1), (D("2020-06-24 03:00"), 3.0)]


@pytest.mark.parametrize("method", ["window", "join"])
def test_from_date_anchor_fills_before_first(spark, method):
    obs = series_df(spark, [(D("2020-06-23 20:00"), 8.0), (D("2020-06-24 03:00"), 3.0)])
    out = rows(resample(obs, "one_hour", from_date="2020-06-24 01:00:00",
                        to_date="2020-06-24 04:00:00", anchor="from_date", method=method))
    assert out == [(D("2020-06-24 01:00"), 0.1), (D("2020-06-24 02:00"), 0.1),
                   (D("2020-06-24 03:00"), 3.0), (D("2020-06-24 04:00"), 0.1)]


def test_null_value_filled(spark):
    obs = series_df(spark, hourly("2020-06-24 01:00", [1.0, None, 3.0]))
    assert [y for _, y in rows(resample(obs, "one_hour"))] == [1.0, 0.1, 3.0]


def test_window_and_join_plans_agree_on_driver_data(spark):
    for g, kw in [("one_hour", {}), ("fifteen_minute", {"to_date": "2024-01-29 23:00:00",
                                                         "from_date": "2024-01-02 00:00:00",
                                                         "anchor": "from_date"})]:
        o = registry.obs(spark, SF_CHECK, g)
        a = resample(o, g, method="window", **kw)
        b = resample(o, g, method="join", **kw)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_unknown_granularity(spark):
    with pytest.raises(ValueError):
        resample(series_df(spark, hourly("2020-06-24 01:00", [1.0])), "one_week")


def _both(df, **kw):
    out = [sorted(((r.name, r.ds, r.y, r.on_grid) for r in resample(df, "one_hour", off_grid="keep", method=m, **kw).collect()),
                  key=str) for m in ("window", "join")]
    assert out[0] == out[1]
    return out[0]


def test_plans_agree_for_any_phase(spark):
    """Window and join plans against a plain loop: random phases of the
    range, sub-second stamps, ranges without observations."""
    import random
    from datetime import datetime, timedelta
    rnd, t0 = random.Random(0), datetime(2024, 1, 1)
    for _ in range(6):
        rows = [(t0 + timedelta(minutes=rnd.choice([0, 0, 0, 30, 7]), hours=rnd.randint(0, 30),
                                microseconds=rnd.choice([0, 0, 500_000, 1])), rnd.random()) for _ in range(rnd.randint(1, 12))]
        df = series_df(spark, rows)
        start = t0 + timedelta(hours=rnd.randint(0, 6), minutes=rnd.choice([0, 30, 7]))
        end = t0 + timedelta(hours=rnd.randint(8, 40), minutes=rnd.choice([0, 30]))
        for kw in ({}, {"anchor": "from_date", "from_date": str(start)}, {"to_date": str(end)},
                   {"anchor": "from_date", "from_date": str(start), "to_date": str(end)}):
            seen = [(d, y) for d, y in rows if (not kw.get("anchor") or d >= start) and (not kw.get("to_date") or d <= end)]
            want = []
            if seen:
                tick = start if kw.get("anchor") else min(seen)[0]
                last = end if kw.get("to_date") else max(seen)[0]
                ticks = set()
                while tick <= last:
                    ticks.add(tick)
                    at = [y for d, y in seen if d == tick]
                    want += [("a", tick, y, True) for y in at or [0.1]]
                    tick += timedelta(hours=1)
                want += [("a", None, y, False) for d, y in seen if d not in ticks]
            assert _both(df, **kw) == sorted(want, key=str)


def test_series_without_observations_in_range_have_their_grid(spark):
    df = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0]), name="a").unionByName(
        series_df(spark, hourly("2020-06-25 00:00", [3.0]), name="b"))
    keys = df.select("name", "unique_id", "id_object").distinct()
    kw = {"anchor": "from_date", "from_date": "2020-06-25 00:00:00", "to_date": "2020-06-25 02:00:00"}
    got = _both(df, series=keys, **kw)
    assert [(n, y) for n, _, y, _ in got] == [("a", 0.1)] * 3 + [("b", 3.0), ("b", 0.1), ("b", 0.1)]
    assert {n for n, *_ in _both(df, **kw)} == {"b"}
    assert _both(df, series=keys, to_date=None, anchor="min") == _both(df)


def test_features_of_a_range_from_the_lags_reach_on(spark):
    """Starts of series let the grid begin at the lags' reach: same rows."""
    import random
    from datetime import datetime, timedelta
    from gridcast.operators.features import build_features
    rnd, t0 = random.Random(1), datetime(2024, 1, 1)
    parts = None
    for name, phase, first in (("a", 0, 0), ("b", 7, 0), ("c", 0, 40), ("d", 30, 70)):
        rows = [(t0 + timedelta(hours=first + h, minutes=phase), rnd.random()) for h in sorted(rnd.sample(range(60), 12))]
        df = series_df(spark, rows, name=name)
        parts = df if parts is None else parts.unionByName(df)
    starts = parts.groupBy("name", "unique_id", "id_object").agg(F.min("ds").alias("start"))
    for method in ("window", "join"):
        kw = dict(from_date="2024-01-02 12:00:00", to_date="2024-01-05 00:00:00", h_lags=2, avg_h=3, use_hour=True, method=method)
        a, b = build_features(parts, "one_hour", **kw), build_features(parts, "one_hour", starts=starts, **kw)
        a, b = (x.withColumn("avg_3", F.round("avg_3", 9)) for x in (a, b))
        assert a.count() > 0 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
