from datetime import datetime

from conftest import hourly, series_df
from gridcast.operators.features import (build_features, exogenous_features, lag_features,
                                         moving_average, time_features)
from gridcast.functions.time import epoch_seconds
from gridcast.operators.resample import resample

D = datetime.fromisoformat


def test_weekend_and_monday_based_week_day(spark):
    obs = series_df(spark, [(D("2020-06-26 12:00"), 1.0), (D("2020-06-27 12:00"), 1.0),
                            (D("2020-06-28 12:00"), 1.0), (D("2020-06-29 12:00"), 1.0)])
    t = {r.ds.date().isoformat(): r for r in time_features(obs).collect()}
    assert [t[d].weekend for d in sorted(t)] == [0, 1, 1, 0]
    e = {r.ds.date().isoformat(): r for r in exogenous_features(obs).collect()}
    assert [e[d].week_day for d in sorted(e)] == [4, 5, 6, 0]
    assert all(e[d].hour_12 == 1 and sum(e[d][f"hour_{h}"] for h in range(24)) == 1 for d in e)


def test_session_time_zone_does_not_move_ticks(spark):
    obs = series_df(spark, hourly("2020-03-29 00:00", [1.0, 2.0, 4.0, 8.0, 16.0]))
    def run():
        df = time_features(resample(obs, "one_hour"))
        return sorted((r.ds, r.y, r.hour) for r in df.withColumn("ep", epoch_seconds("ds")).collect())
    base = run()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
    try:
        assert run() == base
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [h for _, _, h in base] == [0, 1, 2, 3, 4]


def test_lags_and_mean_do_not_leak_across_series(spark):
    a = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0, 3.0]), name="a")
    b = series_df(spark, hourly("2020-06-24 00:00", [10.0, 20.0]), name="b")
    df = moving_average(lag_features(a.unionByName(b), 2), 2)
    got = {(r.name, r.y): (r.lag_1, r.lag_2, r.avg_2) for r in df.collect()}
    assert got[("a", 1.0)] == (None, None, None)
    assert got[("a", 3.0)] == (2.0, 1.0, 1.5)
    assert got[("b", 10.0)] == (None, None, None)
    assert got[("b", 20.0)] == (10.0, None, 10.0)


def test_build_features_range_after_windows(spark):
    obs = series_df(spark, hourly("2020-06-24 00:00", [1.0, 2.0, 3.0, 4.0, 5.0]))
    df = build_features(obs, "one_hour", to_date="2020-06-24 04:00:00",
                        from_date="2020-06-24 02:00:00", h_lags=2, avg_h=2, use_hour=True)
    got = sorted((r.y, r.lag_1, r.lag_2, r.avg_2, r.hour) for r in df.collect())
    assert got == [(3.0, 2.0, 1.0, 1.5, 2), (4.0, 3.0, 2.0, 2.5, 3), (5.0, 4.0, 3.0, 3.5, 4)]


def test_log1p_before_lags(spark):
    import math
    obs = series_df(spark, hourly("2020-06-24 00:00", [0.0, math.e - 1]))
    df = build_features(obs, "one_hour", h_lags=1, log=True)
    (r,) = df.collect()
    assert abs(r.y - 1.0) < 1e-12 and r.lag_1 == 0.0
