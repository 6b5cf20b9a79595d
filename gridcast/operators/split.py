"""Train/test splits and rolling-origin folds.

All of them are window expressions over ``partitionBy(keys).orderBy(ds)``;
no row is ever collected, and the fold table is a closed-form expression,
not a generator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.chunked import position_index
from gridcast.schema import KEYS, horizon


def split_by_rank(df: DataFrame, train_pct: float = 80, keys: Sequence[str] = KEYS,
                  rank_col: str = "pr", method: str = "window") -> DataFrame:
    """``percent_rank`` by ds; train where rank <= train_pct / 100.

    Gives floor(p (n - 1)) + 1 train rows, not floor(p n): see
    :func:`split_by_position` for the positional cut.

    ``method="bounds"``: on a gap-free, duplicate-free grid the rank is
    (ds - first) / (last - first), computed from a per-series aggregate
    joined back (one row per series; AQE broadcasts it once measured small),
    so no task has to hold a whole series. Bit-identical to the window:
    both are the correctly rounded quotient of the same two integers.
    """
    if method == "bounds":
        from gridcast.functions.time import epoch_seconds
        keys = list(keys)
        x = df.withColumn("_ep", epoch_seconds("ds"))
        b = x.groupBy(*keys).agg(F.min("_ep").alias("_lo"), F.max("_ep").alias("_hi"))
        span = F.col("_hi") - F.col("_lo")
        pr = F.when(span > 0, (F.col("_ep") - F.col("_lo")) / span).otherwise(F.lit(0.0))
        x = x.join(b, keys).withColumn(rank_col, pr).drop("_ep", "_lo", "_hi")
        return x.withColumn("is_train", F.col(rank_col) <= F.lit(train_pct / 100))
    if method != "window":
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy(*keys).orderBy("ds")
    return (df.withColumn(rank_col, F.percent_rank().over(w))
            .withColumn("is_train", F.col(rank_col) <= F.lit(train_pct / 100)))


def positions(df: DataFrame, keys: Sequence[str] = KEYS, method: str = "window") -> DataFrame:
    """Add ``idx`` (row number from 0 by ds) and ``n``: by a window over the
    series, or (``method="index"``) by the two-level index of
    ``operators.chunked``, for series too long for one task."""
    if method == "index":
        return position_index(df, keys)
    if method != "window":
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy(*keys).orderBy("ds")
    return (df.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))


def split_by_position(df: DataFrame, train_pct: int = 80, keys: Sequence[str] = KEYS,
                      method: str = "window") -> DataFrame:
    """The first floor(n * train_pct / 100) rows of each series are train."""
    return positions(df, keys, method).withColumn("is_train", F.col("idx") < _cut(F.col("n"), train_pct))


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two halves of a frame carrying ``is_train``."""
    return df.filter("is_train").drop("is_train"), df.filter(~F.col("is_train")).drop("is_train")


def _cut(n: Column, pct: int) -> Column:
    # int(n * pct / 100); exact, both operands being whole numbers
    return F.floor(n * F.lit(int(pct)) / F.lit(100)).cast("long")


def gridded(df: DataFrame) -> DataFrame:
    """The rows on the grid: those that ``resample(off_grid="keep")`` flagged
    as off it (null ``ds``) take no part in folds or fits."""
    return df.filter(F.col("on_grid")).drop("on_grid") if "on_grid" in df.columns else df


def _fold_count(h: int, step: int, on_short: str) -> Column:
    """Folds of a series from ``n`` and ``initial``; a series too short for
    one has none, or fails the job with ``on_short="raise"``."""
    if on_short not in ("skip", "raise"):
        raise ValueError(f"unknown on_short {on_short!r}")
    span = F.col("n") - F.col("initial") - h
    k = F.when(span >= 0, F.floor(span / step) + 1).otherwise(0).cast("long")
    if on_short == "raise":
        k = F.when((F.col("initial") >= 1) & (span >= 0), k).otherwise(
            F.raise_error(F.lit("initial training size + horizon exceeds the series")))
    return k


def _folds_of_row(h: int, n_folds: Column, step: int) -> Column:
    """Ids of the folds whose test window holds a row (at most ceil(h / step))."""
    rel = F.col("idx") - F.col("initial")
    lo = F.greatest(F.lit(0), F.ceil((rel - h + 1) / step)).cast("long")
    hi = F.least(n_folds - 1, F.floor(rel / step)).cast("long")
    return F.when((rel >= 0) & (F.col("initial") >= 1) & (lo <= hi), F.sequence(lo, hi)).otherwise(
        F.array().cast("array<bigint>"))


def explode_folds(df: DataFrame, horizons: Mapping[str, tuple[int, int]],
                  on_short: str = "skip") -> DataFrame:
    """One row per (row, forecast, fold) whose test window holds the row, from
    columns ``idx``, ``n`` and ``initial``: adds ``forecast``, ``fold`` and
    ``d`` (position in the horizon). Used by every rolling evaluation."""
    if on_short == "raise":  # checked on every row, also those in no test window
        longest = [_fold_count(h, step, on_short) >= 0 for h, step in horizons.values()]
        for ok in longest:
            df = df.filter(ok)
    rel = F.col("idx") - F.col("initial")

    def member(name: str, step: int):
        return lambda fold: F.struct(F.lit(name).alias("forecast"), fold.alias("fold"),
                                     (rel - fold * step).alias("d"))

    parts = [F.transform(_folds_of_row(h, _fold_count(h, step, "skip"), step), member(name, step))
             for name, (h, step) in horizons.items()]
    return (df.filter((rel >= 0) & (F.col("initial") >= 1))
            .withColumn("_m", F.explode(F.concat(*parts))).select("*", "_m.*").drop("_m"))


def fold_index(df: DataFrame, h: int, step: int, initial_pct: int | None = 80,
               initial: int | None = None, keys: Sequence[str] = KEYS,
               on_short: str = "skip", method: str = "window") -> DataFrame:
    """Add ``idx`` (row number from 0 by ds), ``n``, ``initial`` and
    ``n_folds`` to every row of every series (see :func:`rolling_folds`)."""
    x = positions(gridded(df), keys, method)
    x = x.withColumn("initial", _initial(initial_pct, initial))
    return x.withColumn("n_folds", _fold_count(h, step, on_short))


def _initial(initial_pct: int | None, initial: int | None) -> Column:
    if initial is not None:
        return F.lit(int(initial)).cast("long")
    if initial_pct is not None:
        return _cut(F.col("n"), initial_pct)
    return F.greatest(F.lit(1), F.floor(F.col("n") / 3)).cast("long")


def rolling_folds(df: DataFrame, h: int, step: int, initial_pct: int | None = 80,
                  initial: int | None = None, keys: Sequence[str] = KEYS,
                  on_short: str = "skip", method: str = "window") -> DataFrame:
    """Expanding-window folds: fold i trains on rows [0, e_i) and tests on
    rows [e_i, e_i + h), e_i = initial + i * step, while e_i + h <= n (W6).

    ``initial`` defaults to floor(n * initial_pct / 100), or max(1, n // 3)
    when both are None. Returns one row per (test row, fold): the input
    columns plus ``idx`` (row number from 0), ``n``, ``initial``, ``fold``,
    ``d`` (position in the horizon, 0..h-1) and ``n_folds``. A row belongs to
    at most ceil(h / step) folds, so the expansion is bounded.

    Series shorter than initial + h have no fold (:func:`skipped_series`
    lists them); ``on_short="raise"`` fails the job on them instead.
    ``method`` as in :func:`positions`.
    """
    x = fold_index(df, h, step, initial_pct, initial, keys, on_short, method)
    return explode_folds(x, {"f": (h, step)}, on_short).drop("forecast")


def skipped_series(df: DataFrame, h: int, step: int, initial_pct: int | None = 80,
                   initial: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series that get no rolling-origin fold (n < initial + h, or an
    initial training size below 1), one row each: keys, n, initial, h and
    the reason. The multi-series counterpart of ``on_short="raise"``: the
    others are evaluated, these are listed. One grouped count per series."""
    keys = list(keys)
    x = gridded(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    init = _initial(initial_pct, initial)
    x = x.withColumns({"initial": init, "h": F.lit(int(h)).cast("long")})
    reason = (F.when(F.col("initial") < 1, F.lit("initial training size below 1"))
              .when(F.col("n") < F.col("initial") + F.col("h"),
                    F.lit("initial training size + horizon exceeds the series")))
    return x.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def fold_counts(df: DataFrame, granularity: str, forecasts: Sequence[str] = ("1_step", "1_hour", "12_hour"),
                initial_pct: int = 80, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series and forecast kind: n, initial, h, step and the number of
    folds (W7). The horizon table is a literal array exploded per series
    row, not a join."""
    per = gridded(df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(f).alias("forecast"), F.lit(horizon(f, granularity)[0]).alias("h"),
                               F.lit(horizon(f, granularity)[1]).alias("step")) for f in forecasts])
    x = per.select(*keys, "n", F.explode(table).alias("hz")).select(*keys, "n", "hz.*")
    x = x.withColumn("initial", _cut(F.col("n"), initial_pct))
    span = F.col("n") - F.col("initial") - F.col("h")
    return x.withColumn("n_folds", F.when(span >= 0, F.floor(span / F.col("step")) + 1)
                        .otherwise(0).cast("long"))
