"""Feature derivation on a regular grid.

Every window is ``partitionBy(series keys).orderBy(ds)``: features never
leak across series, Catalyst pushes key predicates below the windows, and
all windows sharing that spec run in one Window operator on one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.time import (epoch_micros, from_epoch_micros, hour_of_day, range_filter, ts_lit,
                                     weekend_sat_sun)
from gridcast.functions.time import week_day as week_day_of
from gridcast.functions.transforms import log_transform
from gridcast.operators.chunked import halo_features
from gridcast.operators.resample import resample
from gridcast.schema import KEYS, Granularity


def series_window(keys: Sequence[str] = KEYS, order: str = "ds"):
    return Window.partitionBy(*keys).orderBy(order)


def lag_columns(n: int) -> list[str]:
    return [f"lag_{i}" for i in range(1, n + 1)]


def lag_features(df: DataFrame, n: int, col: str = "y", keys: Sequence[str] = KEYS,
                 method: str = "window", granularity: str | Granularity | None = None) -> DataFrame:
    """lag_1 .. lag_n of ``col`` within each series, by ``ds``.

    ``method="shift"`` (needs ``granularity``) computes them without a
    per-series window, for series too long for one task; it requires a
    gap-free, duplicate-free grid (the output of ``resample``).
    ``method="halo"`` does so by chunks that overlap by n rows: rows are
    copied once per chunk, not n times; without ``granularity`` it takes any
    rows (see ``operators.chunked``).
    """
    if method == "shift":
        return _shifted(df, n, col, keys, granularity, lags=n, mean=0)
    if method == "halo":
        return halo_features(df, lags=n, col=col, keys=keys, granularity=granularity)
    w = series_window(keys)
    return df.withColumns({f"lag_{i}": F.lag(col, i).over(w) for i in range(1, n + 1)})


def moving_average(df: DataFrame, n: int, col: str = "y", keys: Sequence[str] = KEYS,
                   method: str = "window", granularity: str | Granularity | None = None) -> DataFrame:
    """Mean of the n previous rows (current row excluded); partial frames
    at the start of a series, null on the first row. ``method="shift"`` and
    ``method="halo"`` as in :func:`lag_features`."""
    if method == "shift":
        return _shifted(df, n, col, keys, granularity, lags=0, mean=n)
    if method == "halo":
        return halo_features(df, mean=n, col=col, keys=keys, granularity=granularity)
    w = series_window(keys).rowsBetween(-n, -1)
    return df.withColumn(f"avg_{n}", F.avg(col).over(w))


def _shifted(df: DataFrame, n: int, col: str, keys: Sequence[str],
             granularity: str | Granularity | None, lags: int, mean: int) -> DataFrame:
    """Lags (the first ``lags``) and trailing mean (of ``mean`` rows) as one
    aggregate keyed by (keys, ds).

    Each row is copied to the n ticks that use it (bounded n-fold expansion)
    and tagged with the distance; grouping by (keys, target ds)
    gathers every row's lags. The shuffle is keyed by ds as well, so a
    single long series spreads over all tasks. Exact on a regular grid
    without gaps or duplicates; rows whose target tick does not exist are
    dropped by the final aggregation (they never carry a ``_self`` part).
    """
    if granularity is None:
        raise ValueError("method='shift' needs the granularity of the grid")
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    keys = list(keys)
    others = [c for c in df.columns if c not in keys and c != "ds"]
    x = df.select(*keys, "ds", *others, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_j"))
    x = x.withColumn("ds", F.timestamp_add("SECOND", F.col("_j") * g.seconds, F.col("ds")))
    own = F.col("_j") == 0
    # the row's own columns one by one (not as one struct): with fixed-width
    # columns every buffer is fixed-width and Spark aggregates by hash, with
    # no sort of the (n + 1)-fold copies on either side of the shuffle
    aggs = [F.max(F.when(own, F.lit(1))).alias("_self")]
    aggs += [F.max(F.when(own, F.col(c))).alias(c) for c in others]
    new = {f"lag_{i}": F.max(F.when(F.col("_j") == i, F.col(col))) for i in range(1, lags + 1)}
    if mean:
        new[f"avg_{mean}"] = F.avg(F.when(F.col("_j").between(1, mean), F.col(col)))
    aggs += [v.alias(c) for c, v in new.items()]
    out = x.groupBy(*keys, "ds").agg(*aggs).filter(F.col("_self").isNotNull())
    return out.select(*keys, "ds", *others, *new)


def time_features(df: DataFrame, hour: bool = True, weekend: bool = True,
                  col: str = "ds") -> DataFrame:
    """``hour`` (0-23) and ``weekend`` (1 on Saturday/Sunday) of ``col``."""
    cols = {}
    if hour:
        cols["hour"] = hour_of_day(col)
    if weekend:
        cols["weekend"] = weekend_sat_sun(col)
    return df.withColumns(cols) if cols else df


def exogenous_columns(hour: bool = True, weekend: bool = True,
                      week_day: bool = True) -> list[str]:
    cols = [f"hour_{h}" for h in range(24)] if hour else []
    return cols + (["weekend"] if weekend else []) + (["week_day"] if week_day else [])


def exogenous_features(df: DataFrame, hour: bool = True, weekend: bool = True,
                       week_day: bool = True, col: str = "ds") -> DataFrame:
    """24 hour-of-day indicators (all present), weekend and week_day
    (0 = Monday). They depend on ``ds`` only, so future rows get them too."""
    cols = {}
    if hour:
        h = hour_of_day(col)
        cols.update({f"hour_{i}": (h == i).cast("int") for i in range(24)})
    if weekend:
        cols["weekend"] = weekend_sat_sun(col)
    if week_day:
        cols["week_day"] = week_day_of(col)
    return df.withColumns(cols)



def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out,
                           handleInvalid="error").transform(df)


def feature_columns(h_lags: int = 0, avg_h: int = 0, use_hour: bool = False,
                    use_weekend: bool = False) -> list[str]:
    return (lag_columns(h_lags) + ([f"avg_{avg_h}"] if avg_h else [])
            + (["hour"] if use_hour else []) + (["weekend"] if use_weekend else []))


def lookback(granularity: str | Granularity, from_date: str, h_lags: int, avg_h: int) -> str:
    """The first ``ds`` that rows from ``from_date`` on can depend on."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    back = (datetime.fromisoformat(from_date) - timedelta(seconds=g.seconds * (max(h_lags, avg_h) + 1)))
    return back.isoformat(sep=" ")


def build_features(obs: DataFrame, granularity: str | Granularity, to_date: str | None = None,
                   from_date: str | None = None, h_lags: int = 0, avg_h: int = 0,
                   use_hour: bool = False, use_weekend: bool = False, log: bool = False,
                   vector: bool = False, keys: Sequence[str] = KEYS,
                   method: str = "window", starts: DataFrame | None = None) -> DataFrame:
    """Gap fill -> time info -> log1p -> lags -> trailing mean -> drop rows
    with a null feature -> optional vector -> ``[from_date, to_date]``.

    The date range is applied **after** the windows, so the first rows in
    range still see their lags. With ``starts`` (keys, ``start``: each series'
    first observation, see ``series_starts``) the grid is built only from the
    last ticks that these lags need: give ``rollup_batch`` the bound of
    :func:`lookback` and no earlier raw row is read. Rows are the same, as
    ``starts`` keeps the phase and tells which series began before.

    ``method="join"`` is the long-series mode: grid by join and lags / mean
    by shifted aggregation, both keyed by (keys, ds), so no task holds a
    whole series. ``method="halo"`` is the same with lags / mean inside
    overlapping chunks.
    """
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    if starts is not None and from_date is not None:
        bound = epoch_micros(ts_lit(lookback(g, from_date, h_lags, avg_h)))
        step, begin = g.seconds * 1_000_000, epoch_micros("start")
        late = F.greatest(F.ceil((bound - begin) / step), F.lit(0))
        starts = starts.select(*keys, from_epoch_micros(begin + late * step).alias("start"))
        obs = range_filter(obs, lookback(g, from_date, h_lags, avg_h), None)
    df = resample(obs, g, to_date=to_date, keys=keys, method="window" if method == "window" else "join",
                  series=starts if from_date else None)
    df = time_features(df, hour=use_hour, weekend=use_weekend)
    if log:
        df = log_transform(df, "log1p")
    if method == "join":
        if h_lags or avg_h:
            df = _shifted(df, max(h_lags, avg_h), "y", keys, g, lags=h_lags, mean=avg_h)
    elif method == "halo":
        df = halo_features(df, h_lags, avg_h, keys=keys, granularity=g) if h_lags or avg_h else df
    else:
        w = series_window(keys)
        cols = {f"lag_{i}": F.lag("y", i).over(w) for i in range(1, h_lags + 1)}
        if avg_h:
            cols[f"avg_{avg_h}"] = F.avg("y").over(w.rowsBetween(-avg_h, -1))
        df = df.withColumns(cols) if cols else df
    feats = feature_columns(h_lags, avg_h, use_hour, use_weekend)
    df = drop_nulls(df, feats or None)
    if vector:
        df = assemble(df, feats)
    return range_filter(df, from_date, to_date)
