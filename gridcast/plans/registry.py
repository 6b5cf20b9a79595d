"""Registered queries: one per operator of the inventory, each reading the
driver tables at ``sf_dir`` and returning a lazy DataFrame.

Double columns are rounded to 6 decimals at the very end (and in the
DuckDB twins in ``oracle.py``) so engine-specific last-digit differences
of sums do not break the value comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gridcast.functions.time import epoch_seconds, from_epoch_seconds, range_filter
from gridcast.functions.transforms import inverse_transform, log_transform
from gridcast.operators.chunked import halo_features
from gridcast.operators.features import (assemble, build_features, drop_nulls, exogenous_features,
                                         lag_features, lookback, moving_average, time_features)
from gridcast.operators.metrics import fold_means, fold_metrics, regression_metrics
from gridcast.operators.resample import resample
from gridcast.operators.rollup import rollup_batch, rollup_coarsen, series_starts
from gridcast.operators.series import (count_series, select_series, select_time_series,
                                       series_counts)
from gridcast.operators.split import (fold_counts, rolling_folds, skipped_series, split_by_position,
                                      split_by_rank)
from gridcast.operators.stationarity import difference_order, difference_series
from gridcast.operators.stages import (DropNullsStage, LagStage, LogStage, MovingAverageStage,
                                      ResampleStage, TimeInfoStage)
from gridcast.plans.grouped import forecast_groups, make_forecaster
from gridcast.plans.grouped_trees import evaluate_trees
from gridcast.plans.long_series import evaluate_rolling_long, prefix_sums
from gridcast.plans.matrix import coarsened_series, run_matrix
from gridcast.plans.rolling import evaluate_rolling, evaluate_rolling_many, rolling_forecast
from gridcast.plans.trees import evaluate_holdout
from gridcast.streaming.rollup import rollup_stream
from gridcast.schema import KEYS, METRIC_COLUMNS, horizon
from gridcast.session import scratch_path, written
from gridcast.sources.observations import read_aggregation, write_observations
from gridcast.sources.sinks import (align_predictions, predictions_table, read_metrics, write_metrics,
                                    write_predictions)
from gridcast.sources.tables import raw_events, raw_from_events, raw_orders, table

K = list(KEYS)
# The date range and series used by the registered queries
# (the events table covers 2024-01-01 .. 2024-01-31).
FROM_DATE = "2024-01-02 00:00:00"
TO_DATE = "2024-01-29 23:00:00"
ONE_SERIES = {"name": "click", "unique_id": 1, "id_object": 6}
MANY_SERIES = [{"name": "view", "unique_id": u, "id_object": 6} for u in (0, 1, 2)]
MIN_OBSERVATIONS = 430
MANY_KEYS = [{"name": n, "unique_id": str(u), "id_object": str(i)}
             for n in ("view", "click") for u in (0, 1, 2) for i in range(1, 61)]
MIN_RAW_ROWS = 650
OFF_PHASE = ("2024-01-02 00:30:00", "2024-01-05 23:30:00")
EMPTY_RANGE = ("2024-03-01 00:00:00", "2024-03-02 12:00:00")
SHORT_SPLIT = (98, 10)

Query = Callable[[SparkSession, str], DataFrame]


# Fixed value: rounding offset shared with the SQL twins. Source values
# have two decimals, so means over power-of-two counts often end exactly
# in ...5 at the 7th decimal; with a plain half-up cut, a 1-ulp difference
# in summation order would flip them. Cutting at 0.4998 keeps exact halves
# away from the boundary.
ROUND_OFFSET = 0.5002


def round6(c: str) -> F.Column:
    """floor(x * 1e6 + 0.5002) / 1e6 in plain double arithmetic, identical
    in every engine (``round`` rounds the decimal string in Spark and the
    binary value elsewhere)."""
    x = F.col(c)
    return F.when(F.abs(x) < 1e12, F.floor(x * 1e6 + ROUND_OFFSET) / 1e6).otherwise(x)


def rounded(df: DataFrame) -> DataFrame:
    cols = {f.name: round6(f.name) for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df


def obs(spark: SparkSession, sf: str, g: str = "one_hour", from_date: str | None = None,
        to_date: str | None = None) -> DataFrame:
    return rollup_batch(raw_events(spark, sf), g, from_date=from_date, to_date=to_date)


def written_obs(spark: SparkSession, sf: str, g: str = "one_hour", from_date: str | None = None,
                to_date: str | None = None) -> DataFrame:
    """Observations rolled up once from the raw table and written to the
    shared scratch folder (the observation table of the production flow).
    Plans that read their input twice (join-based grid, off-grid union,
    long-series mode) then scan this compact table twice, not the raw one:
    their two branches prune and filter the rollup differently, so Spark
    could not share one raw scan and shuffle between them."""
    root = scratch_path(spark, f"observations-{g}")
    write_observations(obs(spark, sf, g, from_date, to_date), root, g)
    return read_aggregation(spark, root, g)


def grid(spark: SparkSession, sf: str, g: str = "one_hour") -> DataFrame:
    return resample(obs(spark, sf, g), g)


def q_rollup_one_hour(spark, sf):
    return rounded(obs(spark, sf, "one_hour"))


def q_rollup_fifteen_minute(spark, sf):
    return rounded(obs(spark, sf, "fifteen_minute"))


def q_rollup_one_day(spark, sf):
    return rounded(rollup_batch(raw_orders(spark, sf), "one_day"))


def q_rollup_coarsen(spark, sf):
    return rounded(rollup_coarsen(obs(spark, sf, "fifteen_minute"), "one_hour"))


def q_read_observations(spark, sf):
    # one pass over the raw table; the coarser granularity from the finer one
    root = scratch_path(spark, "observations")
    write_observations(obs(spark, sf, "fifteen_minute"), root, "fifteen_minute")
    fine = read_aggregation(spark, root, "fifteen_minute", with_counts=True)
    write_observations(rollup_coarsen(fine, "one_hour"), root, "one_hour")
    return rounded(read_aggregation(spark, root, "one_hour"))


def q_select_series(spark, sf):
    return rounded(select_series(obs(spark, sf), ONE_SERIES, columns=["ds", "y"]))


def q_select_many(spark, sf):
    return rounded(select_series(obs(spark, sf), MANY_SERIES, columns=K + ["ds", "y"]))


def q_select_long_list(spark, sf):
    return rounded(select_series(obs(spark, sf), MANY_KEYS, columns=K + ["ds", "y"]))


def q_min_raw_rows(spark, sf):
    return select_time_series(raw_events(spark, sf), MIN_RAW_ROWS, method="semi_join")


def q_series_counts(spark, sf):
    return series_counts(obs(spark, sf, "one_minute"))


def q_min_observations(spark, sf):
    return rounded(select_time_series(obs(spark, sf), MIN_OBSERVATIONS).select(*K, "ds", "y"))


def q_count_series(spark, sf):
    return count_series(select_time_series(obs(spark, sf), MIN_OBSERVATIONS))


def q_resample_grid(spark, sf):
    return rounded(grid(spark, sf))


def q_resample_grid_join(spark, sf):
    return rounded(resample(written_obs(spark, sf), "one_hour", method="join"))


def q_resample_keep_off_grid(spark, sf):
    # quarter-hour observations put on an hourly grid: three in four are off it
    return rounded(resample(written_obs(spark, sf, "fifteen_minute", FROM_DATE, TO_DATE), "one_hour",
                            to_date=TO_DATE, from_date=FROM_DATE, anchor="from_date",
                            off_grid="keep"))


def q_resample_from_date(spark, sf):
    return rounded(resample(obs(spark, sf, "one_hour", FROM_DATE, TO_DATE), "one_hour",
                            to_date=TO_DATE, from_date=FROM_DATE, anchor="from_date"))


def q_resample_off_phase(spark, sf):
    # hourly observations lie on no tick of a half-past grid: filled throughout
    start, end = OFF_PHASE
    return rounded(resample(obs(spark, sf, "one_hour", start, end), "one_hour", to_date=end,
                            from_date=start, anchor="from_date"))


def q_resample_empty_range(spark, sf):
    # a range without observations: every series of the table has its full grid
    start, end = EMPTY_RANGE
    series = raw_events(spark, sf).select(*K).distinct()
    return rounded(resample(obs(spark, sf, "one_hour", start, end), "one_hour", to_date=end,
                            from_date=start, anchor="from_date", series=series))


def q_range_before_fill(spark, sf):
    return rounded(resample(written_obs(spark, sf, "fifteen_minute", FROM_DATE, TO_DATE), "fifteen_minute",
                            to_date=TO_DATE, from_date=FROM_DATE, anchor="from_date",
                            method="join"))


def q_range_after_features(spark, sf):
    # raw rows before the lags' reach are not read; the series' first windows
    # come from a pass over keys and time alone
    raw = raw_events(spark, sf)
    since = lookback("one_hour", FROM_DATE, 2, 2)
    return rounded(build_features(obs(spark, sf, "one_hour", since, TO_DATE), "one_hour", to_date=TO_DATE,
                                  from_date=FROM_DATE, h_lags=2, avg_h=2, use_hour=True,
                                  starts=series_starts(raw, "one_hour")))


def q_lag_features(spark, sf):
    return rounded(lag_features(grid(spark, sf), 3))


def q_lag_features_shift(spark, sf):
    return rounded(lag_features(grid(spark, sf), 3, method="shift", granularity="one_hour"))


def q_moving_average_shift(spark, sf):
    return rounded(moving_average(grid(spark, sf), 3, method="shift", granularity="one_hour"))


def q_moving_average(spark, sf):
    return rounded(moving_average(grid(spark, sf), 3))


def q_lag_features_halo(spark, sf):
    """Lags inside overlapping chunks of the grid: no series window."""
    return rounded(lag_features(grid(spark, sf), 3, method="halo", granularity="one_hour"))


def q_moving_average_halo(spark, sf):
    return rounded(moving_average(grid(spark, sf), 3, method="halo", granularity="one_hour"))


def q_features_halo(spark, sf):
    """A day of lags, a half-day mean and the daily difference of a long series."""
    series = resample(written_obs(spark, sf), "one_hour", method="join")
    return rounded(halo_features(series, lags=24, mean=12, granularity="one_hour", difference=24, chunk=168))


def q_split_by_position_long(spark, sf):
    return rounded(split_by_position(_written_grid(spark, sf, "one_hour"), 80, method="index"))


def q_rolling_folds_long(spark, sf):
    h, step = horizon("1_hour", "fifteen_minute")
    folds = rolling_folds(_written_grid(spark, sf, "fifteen_minute"), h, step, method="index")
    return rounded(folds.select(*K, "fold", "d", "idx", "ds", "y"))


def _written_grid(spark, sf, g):
    """A grid stored once, as the two-level index reads it twice."""
    return written(resample(written_obs(spark, sf, g), g, method="join"), f"grid-{g}")[0]


def q_difference_order(spark, sf):
    """KPSS statistics of 0 to 2 differences and the order they give."""
    return rounded(difference_order(_written_grid(spark, sf, "one_hour")))


def q_differenced_series(spark, sf):
    """Trended series (running totals of the grid), each differenced by its own order."""
    grid_ = _written_grid(spark, sf, "one_hour")
    total = prefix_sums(grid_.withColumn("_pos", epoch_seconds("ds")), K, "_pos", ["y"], chunk=86400)
    totals, _ = written(total.select(*K, "ds", (F.col("cum_y") + F.col("y")).alias("y")), "totals")
    return rounded(difference_series(totals, difference_order(totals)))


def q_drop_nulls(spark, sf):
    df = moving_average(lag_features(grid(spark, sf), 3), 3)
    return rounded(drop_nulls(df, ["lag_1", "lag_2", "lag_3", "avg_3"]))


def q_time_features(spark, sf):
    return rounded(time_features(grid(spark, sf), hour=True, weekend=True))


def q_exogenous_features(spark, sf):
    return rounded(exogenous_features(grid(spark, sf)))


def q_epoch_roundtrip(spark, sf):
    df = obs(spark, sf).select(*K, "ds", epoch_seconds("ds").alias("epoch"))
    return df.withColumn("ds_back", from_epoch_seconds("epoch"))


def q_log1p_roundtrip(spark, sf):
    df = grid(spark, sf).withColumn("y_raw", F.col("y"))
    df = log_transform(df, "log1p").withColumn("y_log", F.col("y"))
    df = inverse_transform(df, "log1p", cols=("y",))
    return rounded(df.select(*K, "ds", "y_raw", "y_log", F.col("y").alias("y_back")))


def q_log_roundtrip(spark, sf):
    df = grid(spark, sf).withColumn("y_raw", F.col("y"))
    df = log_transform(df, "log").withColumn("y_log", F.col("y"))
    df = inverse_transform(df, "log", cols=("y",))
    return rounded(df.select(*K, "ds", "y_raw", "y_log", F.col("y").alias("y_back")))


def q_features_flagship(spark, sf):
    df = build_features(obs(spark, sf), "one_hour", h_lags=2, avg_h=2, use_hour=True)
    return rounded(split_by_rank(df, 80))


def q_features_long_series(spark, sf):
    """The flagship in long-series mode: no per-series window anywhere."""
    df = build_features(written_obs(spark, sf), "one_hour", h_lags=2, avg_h=2, use_hour=True,
                        method="join")
    return rounded(split_by_rank(df, 80, method="bounds"))


def q_split_by_rank(spark, sf):
    return rounded(split_by_rank(grid(spark, sf), 80))


def q_split_by_position(spark, sf):
    return rounded(split_by_position(grid(spark, sf), 80))


def q_train_fraction(spark, sf):
    ranked = split_by_rank(grid(spark, sf), 100)
    counts = ranked.groupBy(*K).agg(*[
        F.count_if(F.col("pr") <= F.lit(25 * m / 100)).alias(f"m{m}") for m in (1, 2, 3, 4)])
    stacked = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"m{m}").alias("n_train"))
                        for m in (1, 2, 3, 4)])
    return counts.select(*K, F.explode(stacked).alias("s")).select(*K, "s.*")


def q_rolling_folds(spark, sf):
    h, step = horizon("1_hour", "fifteen_minute")
    return rounded(rolling_folds(grid(spark, sf, "fifteen_minute"), h, step).select(*K, "fold", "d", "idx", "ds", "y"))


def q_fold_counts(spark, sf):
    return fold_counts(grid(spark, sf), "one_hour")


def q_fold_counts_fifteen_minute(spark, sf):
    return fold_counts(grid(spark, sf, "fifteen_minute"), "fifteen_minute")


def q_fold_counts_one_day(spark, sf):
    return fold_counts(resample(rollup_batch(raw_orders(spark, sf), "one_day"), "one_day"), "one_day",
                       forecasts=("1_step",))


def q_skipped_series(spark, sf):
    pct, h = SHORT_SPLIT
    return skipped_series(obs(spark, sf), h, 1, initial_pct=pct)


def q_keep_grid_folds(spark, sf):
    """Folds of a grid that kept its off-grid rows: those take no part."""
    kept = resample(written_obs(spark, sf, "fifteen_minute"), "one_hour", off_grid="keep")
    return rounded(evaluate_rolling_many(kept, ("naive", "mean"), "one_hour", ("12_hour",)))


def _lag_holdout(spark, sf):
    df = split_by_rank(lag_features(grid(spark, sf), 1), 80)
    return df.filter(~F.col("is_train")).withColumn("yhat", F.col("lag_1"))


def q_regression_metrics(spark, sf):
    return rounded(regression_metrics(_lag_holdout(spark, sf)).select(*K, "rmse", "mse", "mae", "n"))


def q_mape(spark, sf):
    return rounded(regression_metrics(_lag_holdout(spark, sf))
                   .select(*K, "mape_low", "mape", "mape_high"))


def q_fold_means(spark, sf):
    h, step = horizon("12_hour", "one_hour")
    return rounded(fold_means(rolling_forecast(grid(spark, sf), "naive", h, step)))


def q_fold_metrics(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "naive", "one_hour", "1_step"))


def q_rolling_naive(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf, "fifteen_minute"), "naive",
                                    "fifteen_minute", "12_hour"))


def _naive_predictions(spark, sf):
    h, step = horizon("12_hour", "one_hour")
    return rolling_forecast(grid(spark, sf), "naive", h, step)


def q_predictions_table(spark, sf):
    """Written through the prediction sink and read back."""
    path = scratch_path(spark, "predictions")
    table_ = predictions_table(_naive_predictions(spark, sf), extra=["fold"])
    write_predictions(table_.withColumns({"model": F.lit("naive"), "forecast": F.lit("12_hour")}), path)
    return rounded(read_metrics(spark, path).select(*K, "fold", "ds", "y", "yhat"))


def q_align_predictions(spark, sf):
    """Forecasts of each series' next tick paired with the actual values."""
    g = grid(spark, sf)
    ahead = g.select(*K, F.timestamp_add("SECOND", F.lit(3600), F.col("ds")).alias("ds"), F.col("y").alias("yhat"))
    return rounded(align_predictions(ahead, g).select(*K, "ds", "y", "yhat"))


def q_metrics_sink(spark, sf):
    path = scratch_path(spark, "metrics")
    m = evaluate_rolling_many(grid(spark, sf), ("mean",), "one_hour", ("1_step", "12_hour"))
    write_metrics(m.withColumn("granularity", F.lit("one_hour")), path)
    return rounded(read_metrics(spark, path).select(*K, "model", "granularity", "forecast",
                                                   *METRIC_COLUMNS, "n"))


def q_rolling_naive_log(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "naive", "one_hour", "12_hour", log="log"))


def q_ar1_rolling_log(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "ar1", "one_hour", "1_step", log="log1p"))


def q_ar1_rolling(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "ar1", "one_hour", "12_hour"))


def q_trend_rolling(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "trend", "one_hour", "1_step"))


def q_arx_rolling(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "arx", "one_hour", "12_hour"))


def q_trend_seasonal_rolling(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "trend_seasonal", "one_hour", "12_hour"))


def q_ar2_rolling(spark, sf):
    """The regression path with a fixed order and an intercept only."""
    return rounded(evaluate_rolling(grid(spark, sf), "arx", "one_hour", "1_step", p_max=2, pick=False,
                                    calendar=False))


def q_trend_daily_rolling(spark, sf):
    """Trend and one daily wave."""
    return rounded(evaluate_rolling(grid(spark, sf), "trend_seasonal", "one_hour", "12_hour",
                                    harmonics=(1, 0)))


def q_arx_differenced(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "arx", "one_hour", "12_hour", p_max=5, difference=True))


def q_trend_changepoints(spark, sf):
    return rounded(evaluate_rolling(grid(spark, sf), "trend_seasonal", "one_hour", "12_hour", changepoints=3))


def _tree_features(spark, sf):
    return build_features(obs(spark, sf), "one_hour", h_lags=2, avg_h=2, use_hour=True)


TREE_FEATURES = ["lag_1", "lag_2", "avg_2", "hour"]


def q_decision_tree_forecast(spark, sf):
    pred, _ = evaluate_holdout(_tree_features(spark, sf), TREE_FEATURES, "decision_tree")
    return rounded(pred)


def q_gbt_forecast(spark, sf):
    pred, _ = evaluate_holdout(_tree_features(spark, sf), TREE_FEATURES, "gbt")
    return rounded(pred)


def q_tree_test_rows(spark, sf):
    """The rows that a tree model forecasts: every test row, each once."""
    pred, _ = evaluate_holdout(_tree_features(spark, sf), TREE_FEATURES, "decision_tree", key_feature=True)
    return rounded(pred.filter("prediction is not null").select(*K, "ds", "y"))


def q_tree_per_series(spark, sf):
    pred, _ = evaluate_holdout(_tree_features(spark, sf), TREE_FEATURES, "decision_tree", per_series=MANY_SERIES)
    return rounded(pred)


def q_tree_all_series_stumps(spark, sf):
    """One stump per series, all series in one plan."""
    pred, _ = evaluate_trees(_tree_features(spark, sf), TREE_FEATURES, max_depth=1)
    return rounded(pred)


def q_tree_all_series(spark, sf):
    """One tree per series, all series in one plan, with MLlib's default depth and bins."""
    pred, _ = evaluate_trees(_tree_features(spark, sf), TREE_FEATURES, max_depth=5)
    return rounded(pred)


def q_tree_all_series_metrics(spark, sf):
    _, m = evaluate_trees(_tree_features(spark, sf), TREE_FEATURES, max_depth=2)
    return rounded(m)


def q_boosted_trees_all_series(spark, sf):
    pred, _ = evaluate_trees(_tree_features(spark, sf), TREE_FEATURES, "gbt", max_depth=2, rounds=3)
    return rounded(pred)


def q_tree_holdout_metrics(spark, sf):
    _, m = evaluate_holdout(_tree_features(spark, sf), TREE_FEATURES, "decision_tree")
    return rounded(m)


def q_grouped_forecast(spark, sf):
    fn = make_forecaster("mean", "one_hour", "1_step")
    return rounded(forecast_groups(grid(spark, sf), fn))


def q_rollup_stream(spark, sf):
    events = table(spark, sf, "events")
    sink, ckpt = scratch_path(spark, "rollup-sink"), scratch_path(spark, "rollup-ckpt")
    query = rollup_stream(spark, sf, events.schema, raw_from_events, sink, ckpt, "one_hour",
                          file_glob="events.parquet", mode="partial")
    query.awaitTermination()
    return rounded(read_aggregation(spark, sink, "one_hour", with_counts=True, partial=True))


def q_feature_stages(spark, sf):
    from pyspark.ml import Pipeline
    stages = [ResampleStage(granularity="one_hour"), TimeInfoStage(info=["hour"]),
              LagStage(lags=2), MovingAverageStage(n=2),
              DropNullsStage(cols=["lag_1", "lag_2", "avg_2", "hour"])]
    o = obs(spark, sf)
    return rounded(Pipeline(stages=stages).fit(o).transform(o))


def q_log_stage(spark, sf):
    from pyspark.ml import Pipeline
    o = obs(spark, sf)
    return rounded(Pipeline(stages=[ResampleStage(granularity="one_hour"), LogStage(kind="log1p")]).fit(o).transform(o))


def q_assembled_features(spark, sf):
    from pyspark.ml.functions import vector_to_array
    vector = vector_to_array(F.col("features"))
    df = assemble(_tree_features(spark, sf), TREE_FEATURES)
    return rounded(df.select(*K, "ds", *[F.get(vector, F.lit(i)).alias(f"f_{c}") for i, c in enumerate(TREE_FEATURES)]))


MATRIX_MODELS = ("naive", "mean", "ar1", "trend")
MATRIX_GRANULARITIES = ("one_hour", "fifteen_minute")
LONG_FORECASTS = ("1_step", "12_hour")


def q_evaluation_matrix(spark, sf):
    # The raw table is scanned and rolled up once: the finest observations
    # are written to the shared scratch folder (the observation table of
    # the production flow) and every granularity is derived from them.
    root = scratch_path(spark, "matrix-observations")
    write_observations(obs(spark, sf, "fifteen_minute"), root, "fifteen_minute")
    finest = read_aggregation(spark, root, "fifteen_minute", with_counts=True)
    series_for = coarsened_series(finest, "fifteen_minute")
    return rounded(run_matrix(series_for, MATRIX_MODELS, MATRIX_GRANULARITIES))


def q_evaluation_matrix_one_minute(spark, sf):
    return rounded(run_matrix(lambda g: grid(spark, sf, g), ("naive", "mean", "trend"), ("one_minute",),
                              ("1_step", "1_hour")))


def q_evaluation_matrix_models(spark, sf):
    """All model families: running-window, regression and trees."""
    return rounded(run_matrix(lambda g: resample(written_obs(spark, sf, g), g),
                              ("naive", "arx", "trend_seasonal", "decision_tree", "gbt"), ("one_hour",),
                              ("1_step", "12_hour"), tree_params=None))


def q_rolling_long_series(spark, sf):
    """Rolling-origin evaluation of the running-window models in
    long-series mode: grid by join, states by two-level prefix sums, no
    per-series window anywhere."""
    series = resample(written_obs(spark, sf), "one_hour", method="join")
    return rounded(evaluate_rolling_long(series, MATRIX_MODELS, "one_hour", LONG_FORECASTS))


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items()
            if name.startswith("q_") and callable(fn)}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return q_features_flagship(spark, sf)


__all__ = ["queries", "flagship", "rounded", "obs", "grid", "range_filter"]
