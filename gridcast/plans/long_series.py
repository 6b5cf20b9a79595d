"""Rolling-origin evaluation without a per-series window (long-series mode).

For series too long for one task. The grid must be gap-free and
duplicate-free (the output of ``resample``), so a row's position is
(ds - first) / step and its lag is found by the shifted aggregate of
``lag_features(method="shift")``.

Running states are exclusive prefix sums of a few moments, computed as a
two-level scan: per (series, chunk) totals -> per-series running offsets
over the chunks (n / chunk rows) -> running sums inside each chunk. A fold
takes its state from its origin row (its d = 0 test row) by a window over
the fold. Every shuffle is keyed by (series, ds), (series, chunk) or
(series, forecast, fold); the only per-series pieces are one-row bounds
and the chunk offsets.

States from the sums over rows [0, e):
``naive`` y[e-1]; ``mean`` sum(y) / n; ``ar1`` least squares of y_t on
y_{t-1} from (n, sum x, sum y, sum x^2, sum x y) on y centred by the series
mean; ``trend`` the same on (t, y).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.recursion import ar1_ahead
from gridcast.functions.time import epoch_seconds
from gridcast.operators.features import lag_features
from gridcast.operators.metrics import fold_metrics
from gridcast.operators.split import explode_folds
from gridcast.plans.rolling import in_logs, out_of_logs
from gridcast.schema import KEYS, Granularity, horizon

K = list(KEYS)
LONG_SERIES_MODELS = ("naive", "mean", "ar1", "trend")


def prefix_sums(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                chunk: int = 4096) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over the rows of the same key with a
    smaller ``pos`` (exclusive prefix), without a window over a whole key."""
    keys = list(keys)
    x = df.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("long"))
    totals = x.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)).alias(f"_o_{c}") for c in cols])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, -1)
    x = x.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c in cols})
    x = x.join(offsets, keys + ["_chunk"])
    return x.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in cols}).drop(
        "_chunk", *[f"_o_{c}" for c in cols], *[f"_i_{c}" for c in cols])


def _slope(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    var = sxx - sx * sx / n
    b = F.when(var > 0, (sxy - sx * sy / n) / var)
    return sy / n - b * sx / n, b


def rolling_forecast_long(series: DataFrame, models: Sequence[str],
                          horizons: Mapping[str, tuple[int, int]],
                          granularity: str | Granularity, initial_pct: int = 80,
                          chunk: int = 4096, log: str | None = None,
                          on_short: str = "skip") -> DataFrame:
    """Same output as ``rolling_forecast_many``: keys, forecast, model, fold,
    d, idx, ds, y, yhat."""
    unknown = set(models) - set(LONG_SERIES_MODELS)
    if unknown:
        raise ValueError(f"unknown model {sorted(unknown)}")
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    base = in_logs(series, log).withColumn("_ep", epoch_seconds("ds"))
    bounds = base.groupBy(*K).agg(F.min("_ep").alias("_lo"), F.max("_ep").alias("_hi"),
                                  F.avg("y").alias("_c"))
    x = base.join(bounds, K)
    x = x.withColumns({
        "idx": ((F.col("_ep") - F.col("_lo")) / g.seconds).cast("long"),
        "n": ((F.col("_hi") - F.col("_lo")) / g.seconds + 1).cast("long")})
    x = lag_features(x, 1, keys=K, method="shift", granularity=g).withColumnRenamed("lag_1", "_x")
    x = x.withColumn("initial", F.floor(F.col("n") * F.lit(int(initial_pct)) / 100).cast("long"))
    # centred moments (ar1 pairs need a defined lag)
    yc = F.col("y") - F.col("_c")
    xc = F.col("_x") - F.col("_c")
    has = F.col("_x").isNotNull()
    t = F.col("idx").cast("double")
    mom = {"m_one": F.lit(1.0), "m_y": yc,
           "m_pn": F.when(has, 1.0).otherwise(0.0), "m_px": F.when(has, xc).otherwise(0.0),
           "m_py": F.when(has, yc).otherwise(0.0), "m_pxx": F.when(has, xc * xc).otherwise(0.0),
           "m_pxy": F.when(has, xc * yc).otherwise(0.0),
           "m_t": t, "m_tt": t * t, "m_ty": t * yc}
    x = prefix_sums(x.withColumns(mom), K, "idx", list(mom), chunk)

    # Every row's own exclusive prefix sums are the model state of a fold
    # whose origin it is; the origin of a fold is its d = 0 test row, so
    # the state reaches the fold's other rows by first() over the fold
    # (at most h rows), with no join and no second pass over the series.
    n = F.col("cum_m_one")
    ar_a, ar_b = _slope(F.col("cum_m_pn"), F.col("cum_m_px"), F.col("cum_m_py"),
                        F.col("cum_m_pxx"), F.col("cum_m_pxy"))
    tr_a, tr_b = _slope(n, F.col("cum_m_t"), F.col("cum_m_y"), F.col("cum_m_tt"),
                        F.col("cum_m_ty"))
    state = {"_last": F.col("_x"), "_mean": F.col("cum_m_y") / n, "_ar_a": ar_a,
             "_ar_b": ar_b, "_tr_a": tr_a, "_tr_b": tr_b}
    tests = explode_folds(x, horizons, on_short).select(
        *K, "idx", "ds", "y", "_c", "forecast", "fold", "d", *[v.alias(c) for c, v in state.items()])
    origin = Window.partitionBy(*K, "forecast", "fold").orderBy("d")
    j = tests.withColumns({c: F.first(c).over(origin) for c in state})
    c = F.col("_c")
    yhat = {"naive": F.col("_last"),
            "mean": F.col("_mean") + c,
            "ar1": ar1_ahead(F.col("_ar_a"), F.col("_ar_b"), F.col("_last") - c,
                             F.col("d") + 1) + c,
            "trend": F.col("_tr_a") + F.col("_tr_b") * F.col("idx").cast("double") + c}
    stacked = F.array(*[F.struct(F.lit(m).alias("model"), yhat[m].alias("yhat")) for m in models])
    out = j.withColumn("_s", F.explode(stacked)).select("*", "_s.*")
    return out_of_logs(out.select(*K, "forecast", "model", "fold", "d", "idx", "ds", "y", "yhat"), log)


def evaluate_rolling_long(series: DataFrame, models: Sequence[str],
                          granularity: str | Granularity, forecasts: Sequence[str],
                          initial_pct: int = 80, level: str = "fold", log: str | None = None,
                          on_short: str = "skip") -> DataFrame:
    horizons = {fc: horizon(fc, granularity) for fc in forecasts}
    pred = rolling_forecast_long(series, models, horizons, granularity, initial_pct, log=log,
                                 on_short=on_short)
    return fold_metrics(pred, by=[*K, "forecast", "model"], level=level)
