from datetime import datetime, timedelta

import pytest

from conftest import hourly, series_df
from gridcast.operators.split import (fold_counts, rolling_folds, split_by_position,
                                      split_by_rank)


def brute_folds(n, h, step, initial):
    """Expanding-window folds written as the plain loop."""
    out, start = [], 0
    while start + initial + h <= n:
        end = start + initial
        out.append(list(range(end, end + h)))
        start += step
    return out


def quarter_hours(spark, n):
    t0 = datetime(2020, 6, 24, 1)
    return series_df(spark, [(t0 + timedelta(minutes=15 * i), float(i)) for i in range(n)])


@pytest.mark.parametrize("n,h,step", [(665, 48, 4), (167, 12, 1), (167, 1, 1), (30, 4, 4), (25, 7, 3)])
def test_rolling_folds_match_loop(spark, n, h, step):
    got = rolling_folds(quarter_hours(spark, n), h, step).collect()
    want = brute_folds(n, h, step, n * 80 // 100)
    pairs = sorted((r.fold, r.idx) for r in got)
    assert pairs == sorted((f, i) for f, rows in enumerate(want) for i in rows)
    assert all(r.d == r.idx - r.initial - r.fold * step for r in got)
    if (n, h, step) == (665, 48, 4):
        assert len(want) == 22 and len(pairs) == 1056


def test_default_initial_is_a_third(spark):
    got = rolling_folds(quarter_hours(spark, 30), 2, 2, initial_pct=None).collect()
    want = brute_folds(30, 2, 2, max(1, 30 // 3))
    assert sorted((r.fold, r.idx) for r in got) == sorted(
        (f, i) for f, rows in enumerate(want) for i in rows)


def test_short_series_skip_or_raise(spark):
    df = quarter_hours(spark, 5)
    assert rolling_folds(df, 4, 1).count() == 0
    with pytest.raises(Exception):
        rolling_folds(df, 4, 1, on_short="raise").collect()


def test_rank_and_position_splits_differ(spark):
    for n, rank_train, pos_train in [(6, 5, 4), (167, 133, 133)]:
        df = series_df(spark, hourly("2020-06-24 01:00", [1.0] * n))
        assert split_by_rank(df, 80).filter("is_train").count() == rank_train
        assert split_by_position(df, 80).filter("is_train").count() == pos_train


def test_fold_counts_one_hour(spark):
    df = series_df(spark, hourly("2020-06-24 01:00", [1.0] * 167))
    got = {r.forecast: r.n_folds for r in fold_counts(df, "one_hour").collect()}
    assert got == {"1_step": 34, "1_hour": 34, "12_hour": 23}
    df15 = quarter_hours(spark, 665)
    got = {r.forecast: r.n_folds for r in fold_counts(df15, "fifteen_minute").collect()}
    assert got == {"1_step": 133, "1_hour": 33, "12_hour": 22}


def test_skipped_series_lists_the_short_ones(spark):
    from pyspark.sql import functions as F
    from gridcast.operators.split import skipped_series
    df = quarter_hours(spark, 5).unionByName(
        quarter_hours(spark, 40).withColumn("unique_id", F.lit("2")))
    got = skipped_series(df, 4, 1).collect()
    assert [(r.unique_id, r.n, r.initial) for r in got] == [("1", 5, 4)]
    # the same series get no fold in rolling_folds, the others keep theirs
    folded = {r.unique_id for r in rolling_folds(df, 4, 1).select("unique_id").distinct().collect()}
    assert folded == {"2"}
    assert [r.reason for r in skipped_series(quarter_hours(spark, 1), 1, 1)
            .collect()] == ["initial training size below 1"]


def test_off_grid_rows_take_no_part_in_folds(spark):
    from gridcast.operators.resample import resample
    t0 = datetime(2020, 6, 24, 1)
    rows = [(t0 + timedelta(hours=i), float(i)) for i in range(20)]
    rows.append((t0 + timedelta(hours=3, minutes=30), 99.0))  # off the hourly grid
    kept = resample(series_df(spark, rows), "one_hour", off_grid="keep")
    dropped = resample(series_df(spark, rows), "one_hour")
    a = sorted((r.fold, r.idx, r.y) for r in rolling_folds(kept, 2, 1).collect())
    b = sorted((r.fold, r.idx, r.y) for r in rolling_folds(dropped, 2, 1).collect())
    assert a == b and len(a) > 0
