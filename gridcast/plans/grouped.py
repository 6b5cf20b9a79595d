"""Pluggable grouped-map forecasting.

``forecast_groups`` runs a user function once per series with
``groupBy(keys).applyInPandas``: one hash shuffle by series key, one Arrow
batch per series into a Python worker, one metrics row back. It is the
escape hatch for single-machine forecasting libraries. Each group is one
series **on the regular grid** (after rollup and gap filling), so a group
holds at most span / granularity rows, however large the raw table is.
The group is sorted by ``ds`` inside the function: an ``orderBy`` before
the grouping does not survive the shuffle.

``make_forecaster`` is a factory of such functions from settings; its
built-in models (``naive``, ``mean``, ``trend``, ``ar1``) evaluate by rolling
origin with per-fold means, exactly like ``evaluate_rolling``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridcast.schema import KEYS, horizon

GROUPED_SCHEMA = ("name string, unique_id string, id_object int, "
                  "MAPE double, RMSE double, MSE double, MAE double")

GroupFn = Callable[[tuple, pd.DataFrame], pd.DataFrame]


def forecast_groups(df: DataFrame, fn: GroupFn, schema: str = GROUPED_SCHEMA,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(key, pdf.sort_values("ds", kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def _forecasts(model: str, y: np.ndarray, origins: np.ndarray, h: int) -> np.ndarray:
    """(origins, h) forecasts from the rows before each origin."""
    def before(x: np.ndarray) -> np.ndarray:  # sums in the order of a running window
        return np.concatenate([[0.0], np.cumsum(x)])[origins]

    n, ahead = origins.astype(float), np.arange(h)
    if model in ("naive", "mean"):
        level = y[origins - 1] if model == "naive" else before(y) / n
        return np.repeat(level[:, None], h, axis=1)
    ref = y[: origins[0]].mean()  # centred sums: the least-squares line does not depend on it
    z = y - ref
    if model == "trend":
        t = np.arange(len(y)) - origins[0] / 2
        x, k = t, n
        sx, sy, sxx, sxy = before(x), before(z), before(x * x), before(x * z)
    else:  # ar1: pairs (z[t-1], z[t]), the first row having none
        x, k = np.concatenate([[0.0], z[:-1]]), n - 1
        pair = np.arange(len(y)) > 0
        sx, sy, sxx, sxy = before(x * pair), before(z * pair), before(x * x * pair), before(x * z * pair)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = (sxy - sx * sy / k) / (sxx - sx * sx / k)
        a = (sy - b * sx) / k
    if model == "trend":
        return a[:, None] + b[:, None] * (t[origins][:, None] + ahead) + ref
    out, level = np.empty((len(origins), h)), z[origins - 1]
    for d in range(h):
        level = a + b * level
        out[:, d] = level
    return out + ref


GROUPED_MODELS = ("naive", "mean", "trend", "ar1")
_LOGS = {"log1p": (np.log1p, np.expm1), "log": (np.log, np.exp)}


def make_forecaster(model: str = "mean", granularity: str = "one_hour",
                    forecast: str = "1_step", initial_pct: int = 80, from_date: str | None = None,
                    to_date: str | None = None, log: str | None = None, on_short: str = "skip") -> GroupFn:
    """``from_date`` / ``to_date`` bound the rows used (both included);
    ``log`` fits in logs and takes errors on the original scale;
    ``on_short="raise"`` fails on a series too short for one fold."""
    if model not in GROUPED_MODELS:
        raise ValueError(f"unknown grouped model {model!r}")
    if on_short not in ("skip", "raise"):
        raise ValueError(f"unknown on_short {on_short!r}")
    h, step = horizon(forecast, granularity)
    into, back = _LOGS[log] if log else (None, None)

    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["name", "unique_id", "id_object", "MAPE", "RMSE", "MSE", "MAE"]
        if from_date:
            pdf = pdf[pdf["ds"] >= pd.Timestamp(from_date)]
        if to_date:
            pdf = pdf[pdf["ds"] <= pd.Timestamp(to_date)]
        y = pdf["y"].to_numpy(dtype=np.float64)
        n = len(y)
        init = n * initial_pct // 100
        if init < 1 or init + h > n:
            if on_short == "raise":
                raise ValueError("initial training size + horizon exceeds the series")
            return pd.DataFrame(columns=cols)
        origins = np.arange(init, n - h + 1, step)
        fitted = into(y) if log else y
        pred = _forecasts(model, fitted, origins, h)
        windows = np.lib.stride_tricks.sliding_window_view(fitted, h)[origins]
        if log:
            pred, windows = back(pred), back(windows)
        # sequential sums (cumsum), the summation order of a running window
        err = np.cumsum(windows, axis=1)[:, -1] / h - np.cumsum(pred, axis=1)[:, -1] / h
        actual = np.cumsum(windows, axis=1)[:, -1] / h
        with np.errstate(divide="ignore", invalid="ignore"):
            pe = np.abs(err / actual) * 100
        mse = float(np.mean(err * err))
        return pd.DataFrame([[key[0], str(key[1]), int(key[2]), float(np.mean(pe)),
                              float(np.sqrt(mse)), mse, float(np.mean(np.abs(err)))]],
                            columns=cols)

    return fn
