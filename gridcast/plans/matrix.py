"""Evaluation matrix (X1): models x granularities x forecast kinds as rows
of one DataFrame instead of nested driver loops of jobs.

Per granularity, all running-window models and all forecast kinds are
evaluated in one pass over the gridded series (``evaluate_rolling_many``):
one rollup shuffle and one series shuffle per granularity, whatever the
number of models and horizons. Regression models add one branch each; tree
models are fitted once per granularity on lag / mean / hour features of the
same grid and evaluated on the ordered holdout (forecast kind ``holdout``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.plans.rolling import SIMPLE_MODELS, evaluate_rolling, evaluate_rolling_many
from gridcast.operators.features import (drop_nulls, feature_columns, lag_features, moving_average,
                                         time_features)
from gridcast.plans.trees import TREE_MODELS, evaluate_holdout
from gridcast.schema import HORIZONS, Granularity

SeriesFor = Callable[[str], DataFrame]


def coarsened_series(finest: DataFrame, finest_granularity: str, **resample_kw) -> SeriesFor:
    """``series_for`` that reads the raw table once: the finest rollup is
    used as it is, every coarser granularity is rolled up from it exactly
    (additive ``n`` / ``total``, ``rollup_coarsen``), then gap-filled.
    At scale this replaces one raw scan and raw shuffle per granularity by
    one, plus small shuffles of the observation table."""
    from gridcast.operators.resample import resample
    from gridcast.operators.rollup import rollup_coarsen
    base = Granularity.of(finest_granularity)

    # every branch reads only (n, total) of the finest rollup, so all of them
    # share one aggregate and one exchange of the raw table (y = total / n is
    # what avg computes)
    exact = finest.withColumn("y", F.col("total") / F.col("n"))

    def series_for(g: str) -> DataFrame:
        if Granularity.of(g).seconds % base.seconds:
            raise ValueError(f"{g} is not a multiple of {finest_granularity}")
        obs = exact if g == base.name else rollup_coarsen(exact, g)
        return resample(obs, g, **resample_kw)

    return series_for


def run_matrix(series_for: SeriesFor, models: Sequence[str], granularities: Sequence[str],
               forecasts: Sequence[str] = ("1_step", "1_hour", "12_hour"),
               initial_pct: int = 80, tree_params: dict | None = None) -> DataFrame:
    """``series_for(granularity)`` returns the gridded series; the result
    has one metrics row per (series, model, granularity, forecast)."""
    parts = []
    simple = [m for m in models if m in SIMPLE_MODELS]
    for g in granularities:
        series = series_for(g)
        fcs = [fc for fc in forecasts if Granularity.of(g).freq in HORIZONS[fc]]
        if simple and fcs:
            # every simple model and forecast kind in one pass over the series
            parts.append(evaluate_rolling_many(series, simple, g, fcs, initial_pct)
                         .withColumn("granularity", F.lit(g)))
        trees = [m for m in models if m in TREE_MODELS]
        if trees:
            cols = feature_columns(2, 2, True)
            table = drop_nulls(time_features(moving_average(lag_features(series, 2), 2), weekend=False), cols)
            parts += [evaluate_holdout(table, cols, m, initial_pct, **(tree_params or {}))[1].withColumns(
                {"model": F.lit(m), "granularity": F.lit(g), "forecast": F.lit("holdout")}) for m in trees]
        for fc in fcs:
            for m in models:
                if m not in SIMPLE_MODELS and m not in TREE_MODELS:
                    parts.append(evaluate_rolling(series, m, g, fc, initial_pct).withColumns(
                        {"model": F.lit(m), "granularity": F.lit(g), "forecast": F.lit(fc)}))
    if not parts:
        raise ValueError("empty evaluation matrix")
    return reduce(DataFrame.unionByName, parts)
