"""Rolling-origin evaluation (M6) with forecasters whose refit is a
running window aggregate.

Refitting at every origin on all rows before it is, for these models, an
aggregate over ``rowsBetween(unboundedPreceding, -1)``: Spark computes such
frames incrementally, so all folds of a series cost one ordered pass
instead of one fit per fold. A model's state at a row does not depend on
the horizon, so one pass serves every model and every forecast kind: each
row is exploded into the (forecast, fold) pairs whose test window holds it
(at most ceil(h / step) per kind), each fold takes its state from its
origin row with ``first()`` over ``partitionBy(keys, forecast, fold)``, and
the models are stacked into rows. The partitioning by series keys already
satisfies every later window and aggregate: no extra shuffle.

Models (state computed at every row from the rows before it):

``naive``  last value y[e-1] for the whole horizon.
``mean``   mean of all rows before the origin.
``ar1``    y_t = a + b y_{t-1} by least squares (``regr_intercept`` /
           ``regr_slope``), forecast recursively from y[e-1] (the recursion
           in closed form, O(1) per row whatever the horizon).
``trend``  y = a + b t with t the row index; forecast a + b t.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.recursion import ar1_ahead
from gridcast.operators.metrics import fold_metrics
from gridcast.functions.transforms import inverse_transform, log_transform
from gridcast.operators.split import explode_folds, fold_index, gridded
from gridcast.schema import KEYS, Granularity, horizon

SIMPLE_MODELS = ("naive", "mean", "ar1", "trend")


def _states(df: DataFrame, models: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("ds")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    unknown = set(models) - set(SIMPLE_MODELS)
    if unknown:
        raise ValueError(f"unknown model {sorted(unknown)}; expected one of {SIMPLE_MODELS}")
    df = df.withColumn("_last", F.lag("y", 1).over(w))
    cols = {}
    if "mean" in models:
        cols["_mean"] = F.avg("y").over(past)
    if "ar1" in models:
        cols["_ar_a"] = F.regr_intercept("y", "_last").over(past)
        cols["_ar_b"] = F.regr_slope("y", "_last").over(past)
    if "trend" in models:
        t = (F.row_number().over(w) - 1).cast("double")
        df = df.withColumn("_t", t)
        cols["_tr_a"] = F.regr_intercept("y", "_t").over(past)
        cols["_tr_b"] = F.regr_slope("y", "_t").over(past)
    return df.withColumns(cols) if cols else df


def _forecast(model: str):
    origin = Window.partitionBy(*KEYS, "forecast", "fold").orderBy("idx")

    def at_origin(c):
        return F.first(c).over(origin)

    if model == "naive":
        return at_origin("_last")
    if model == "mean":
        return at_origin("_mean")
    if model == "ar1":
        # y[e+d] = a + b y[e+d-1], starting from y[e-1]: d + 1 steps
        return ar1_ahead(at_origin("_ar_a"), at_origin("_ar_b"), at_origin("_last"),
                         F.col("d") + 1)
    if model == "trend":
        return at_origin("_tr_a") + at_origin("_tr_b") * F.col("idx").cast("double")
    raise ValueError(f"unknown model {model!r}")


def in_logs(series: DataFrame, log: str | None) -> DataFrame:
    """The on-grid rows (keys, ds, y) that every rolling evaluation starts
    from, the target in logs (``log1p`` or ``log``) if asked."""
    rows = gridded(series).select(*KEYS, "ds", "y")
    return log_transform(rows, log) if log else rows


def out_of_logs(pred: DataFrame, log: str | None) -> DataFrame:
    """Actual values and forecasts back on the original scale, before any
    error is taken."""
    return inverse_transform(pred, log, cols=("y", "yhat")) if log else pred


def rolling_forecast_many(series: DataFrame, models: Sequence[str],
                          horizons: Mapping[str, tuple[int, int]],
                          initial_pct: int = 80, log: str | None = None,
                          on_short: str = "skip") -> DataFrame:
    """Per test row, forecast kind, fold and model: keys, forecast, model,
    fold, d, idx, ds, y, yhat. ``horizons`` maps a forecast name to (h, step)."""
    base = _states(in_logs(series, log), models)
    x = fold_index(base, 1, 1, initial_pct=initial_pct).drop("n_folds")
    x = explode_folds(x, horizons, on_short)
    x = x.withColumns({f"_yhat_{m}": _forecast(m) for m in models})
    stacked = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_yhat_{m}").alias("yhat"))
                        for m in models])
    x = x.withColumn("_s", F.explode(stacked)).select("*", "_s.*")
    return out_of_logs(x.select(*KEYS, "forecast", "model", "fold", "d", "idx", "ds", "y", "yhat"), log)


def rolling_forecast(series: DataFrame, model: str, h: int, step: int,
                     initial_pct: int = 80, log: str | None = None,
                     on_short: str = "skip") -> DataFrame:
    """Per test row and fold: keys, fold, d, idx, ds, y, yhat."""
    out = rolling_forecast_many(series, [model], {"f": (h, step)}, initial_pct, log, on_short)
    return out.select(*KEYS, "fold", "d", "idx", "ds", "y", "yhat")


def evaluate_rolling_many(series: DataFrame, models: Sequence[str],
                          granularity: str | Granularity, forecasts: Sequence[str],
                          initial_pct: int = 80, level: str = "fold", log: str | None = None,
                          on_short: str = "skip") -> DataFrame:
    """Metrics per (series, forecast, model) for several models and forecast
    kinds in one pass over the series."""
    horizons = {fc: horizon(fc, granularity) for fc in forecasts}
    pred = rolling_forecast_many(series, models, horizons, initial_pct, log, on_short)
    return fold_metrics(pred, by=[*KEYS, "forecast", "model"], level=level)


def evaluate_rolling(series: DataFrame, model: str, granularity: str | Granularity,
                     forecast: str = "1_step", initial_pct: int = 80,
                     level: str = "fold", log: str | None = None, on_short: str = "skip",
                     **options) -> DataFrame:
    """Rolling-origin metrics per series for one model and forecast kind;
    ``options`` go to the regression models."""
    h, step = horizon(forecast, granularity)
    if model in SIMPLE_MODELS:
        pred = rolling_forecast(series, model, h, step, initial_pct, log, on_short)
    else:
        from gridcast.plans.regression import rolling_regression
        pred = rolling_regression(series, model, granularity, h, step, initial_pct, log=log,
                                  on_short=on_short, **options)
    return fold_metrics(pred, by=KEYS, level=level)
