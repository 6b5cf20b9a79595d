"""Positions, lags and means without a series window, against the windows
over whole series and plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridcast.operators import chunked
from gridcast.operators.features import lag_features, moving_average
from gridcast.operators.resample import resample
from gridcast.operators.split import fold_index, rolling_folds, split_by_position
from gridcast.plans import registry, regression
from gridcast.schema import KEYS

K = list(KEYS)
SCHEMA = "name string, unique_id string, id_object int, ds timestamp_ntz, y double"


def irregular(spark, seed=3):
    """Three series (one with null keys, one of one row) with gaps of minutes to months."""
    r, rows = random.Random(seed), []
    for name, n in (("a", 300), (None, 90), ("one", 1)):
        t = datetime(2019, 12, 30, 23, 59, 30)
        for i in range(n):
            t += timedelta(seconds=r.choice([1, 60, 3600, 86400, 40 * 86400]))
            rows.append((name, None if name is None else "1", 6, t, None if i % 17 == 5 else float(i)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def hours(spark, n=700, start=datetime(2023, 12, 28, 5)):
    rows = [(s, "1", 6, start + timedelta(hours=i), float((i * 7919 + k) % 101)) for k, s in enumerate("ab") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def exchanges(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return [x.split("hashpartitioning(")[1].split(", ENSURE")[0] for x in plan.splitlines() if "hashpartitioning(" in x]


@pytest.mark.parametrize("bucket", [60, 86400, chunked.BUCKET])
def test_positions_equal_the_series_window(spark, bucket):
    df = irregular(spark)
    want = split_by_position(df).select(*K, "ds", "idx", "n")
    assert rows_of(chunked.position_index(df, bucket=bucket), *K, "ds", "idx", "n") == rows_of(want)


def test_positions_with_null_times_ties_and_no_rows(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "1", 6, x, 1.0) for x in (None, t, t, t + timedelta(days=30))], SCHEMA)
    got = chunked.position_index(df).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 1, 2, 3] and {r.n for r in got} == {4}
    assert got[0].ds is None and got[3].ds == t + timedelta(days=30)
    assert chunked.position_index(df.limit(0)).count() == 0


@pytest.mark.parametrize("method", ["index"])
def test_folds_and_split_by_index(spark, method):
    df = hours(spark)
    for args in ((12, 1), (4, 4)):
        cols = [*K, "ds", "fold", "d", "idx", "n", "initial", "n_folds"]
        assert rows_of(rolling_folds(df, *args, method=method), *cols) == rows_of(rolling_folds(df, *args), *cols)
    assert rows_of(split_by_position(df, 75, method=method)) == rows_of(split_by_position(df, 75))
    with pytest.raises(ValueError):
        fold_index(df, 1, 1, method="other")


@pytest.mark.parametrize("chunk,lags,mean", [(24, 24, 12), (25, 3, 24), (4096, 2, 2), (7, 0, 5), (7, 7, 0)])
def test_halo_equals_the_series_window(spark, chunk, lags, mean):
    df = hours(spark)
    want = lag_features(df, lags) if lags else df
    want = moving_average(want, mean) if mean else want
    for granularity in ("one_hour", None):
        got = chunked.halo_features(df, lags, mean, granularity=granularity, chunk=chunk)
        assert rows_of(got) == rows_of(want)


def test_halo_of_irregular_rows_reads_rows_not_times(spark):
    df = irregular(spark)
    want = moving_average(lag_features(df, 5), 4).withColumn("diff_5", F.col("y") - F.col("lag_5"))
    got = chunked.halo_features(df, lags=5, mean=4, difference=5, chunk=11)
    assert rows_of(got) == rows_of(want, *got.columns)


def test_halo_wider_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        chunked.halo_features(hours(spark, 10), lags=9, chunk=8, granularity="one_hour")


def test_a_chunk_copies_only_its_halo(spark):
    x = chunked.halo(hours(spark, 240), chunked.tick("one_hour"), 3, 24)
    assert x.filter("_copy").count() <= 2 * 3 * (240 // 24 + 1)


def test_no_shuffle_of_rows_by_series(spark):
    grid = resample(registry.obs(spark, SF_SMALL), "one_hour", method="join")
    parts = exchanges(chunked.halo_features(grid, 24, 12, granularity="one_hour"))
    assert parts and any("_chunk#" in p for p in parts)
    # keyed by series alone: only the grid's bounds, one row per series
    stored, _ = registry.written(grid, "plan-grid")
    for df in (chunked.halo_features(stored, 24, 12, granularity="one_hour"),
               rolling_folds(stored, 12, 1, method="index")):
        by_series = [p for p in exchanges(df) if "_chunk#" not in p and "_slot#" not in p]
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        windows = [x for x in lines if "Window [" in x]
        assert all("_chunk#" in x or "_slot#" in x or "sum(_n#" in x for x in windows), windows
        assert len(by_series) <= 1  # the bucket counts of the index


def test_regression_shuffles_rows_by_chunk_and_grams_by_fold(spark, monkeypatch):
    seen = {}
    real = regression.written

    def spy(df, name):
        seen[name] = exchanges(df)
        return real(df, name)

    monkeypatch.setattr(regression, "written", spy)
    df = regression.rolling_regression(hours(spark, 120), "arx", "one_hour", 1, 1, p_max=2)
    assert any("_chunk#" in p for p in seen["lagged"])
    assert any("fold#" in p for p in seen["gram-blocks"])  # an exchange by (series, fold) below the Gram sums
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
