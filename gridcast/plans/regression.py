"""Rolling-origin least-squares forecasters with many regressors (M4, M5,
M7): an autoregression with exogenous calendar columns (``arx``) and a
(piecewise) trend plus daily / weekly Fourier model (``trend_seasonal``).

Refit-per-origin without refitting: fold i trains on rows [0, e_i), and
rows are cut into blocks at the origins (block 0 = [0, e_0), block i =
[e_{i-1}, e_i)). Rows are numbered by the two-level index and get their lags
inside overlapping chunks (``operators.chunked``), so they lie by (series,
chunk), never by series alone; they are written once. One grouped aggregate
gives each block's Gram matrix Z'Z of z = [x, y]: partial sums on the rows'
side, then a shuffle by (series, block), one row per fold, with the fold's
origin row beside it; the blocks are written once as well. Every fold's normal
equations are a running sum of the blocks, taken in two levels: totals per
(series, chunk of blocks), their exclusive running sums over the chunks, and a
running sum inside each chunk in numpy, where the chunk's folds are solved and
forecast. No task holds more than a chunk of rows or of Grams, however long a
series is.

Columns are centred and scaled per series by statistics of the first training
window, and each normal matrix is brought to unit diagonal and solved by a
pseudo-inverse with a rank cut. So a forecast follows the unit and the origin
of y, is the plain least-squares one where the columns are independent, and
the minimum-norm one where they are not.

The AR order of ``arx`` (0 to ``p_max``, or exactly ``p_max`` with
``pick=False``) is chosen once per series by AIC on the first training window
and kept for every fold; coefficients are refitted per fold. All orders are
sub-matrices of the largest Gram.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridcast.functions.time import epoch_seconds
from gridcast.operators.chunked import attach, halo, inside_chunks, without_copies
from gridcast.operators.features import exogenous_columns, exogenous_features
from gridcast.operators.split import explode_folds, fold_index
from gridcast.plans.rolling import in_logs, out_of_logs
from gridcast.schema import KEYS, Granularity
from gridcast.session import forget, written

K = list(KEYS)
REGRESSION_MODELS = ("arx", "trend_seasonal")
#: blocks of a series that one task solves together
CHUNK = 512
#: rows of a series that meet its statistics in one place
CHUNK_ROWS = 4096
#: share of the largest eigenvalue under which a direction counts as absent
RANK_CUT = 1e-11
_DAY, _WEEK = 86400.0, 604800.0


def _waves(harmonics: tuple[int, int]) -> list[tuple[str, float]]:
    """(column suffix, angular speed per second) of the Fourier terms."""
    return [(f"{tag}{k}", 2 * math.pi * k / period) for period, tag, nk in (
        (_DAY, "d", harmonics[0]), (_WEEK, "w", harmonics[1])) for k in range(1, nk + 1)]


def _design(base: DataFrame, model: str, p: int, harmonics: tuple[int, int],
            changepoints: int, calendar: bool) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, exogenous columns, lag columns); ``base`` has idx, initial, _ep
    and the scaled target _z with its lags _lag_1 .. _lag_p."""
    if model == "arx":
        lags = [f"_lag_{j}" for j in range(1, p + 1)]
        if not calendar:
            return base.withColumn("one", F.lit(1.0)), ["one"], lags
        df = exogenous_features(base).withColumn("week_day", (F.col("week_day") - 3) / 2.0)
        return df, exogenous_columns(), lags
    if model == "trend_seasonal":
        span = F.greatest(F.col("initial"), F.lit(1)).cast("double")
        cols = {"one": F.lit(1.0), "t": F.col("idx") / span - 0.5}
        for j in range(1, changepoints + 1):
            cols[f"t_{j}"] = F.greatest(F.col("idx") / span - j / (changepoints + 1.0), F.lit(0.0))
        for tag, speed in _waves(harmonics):
            cols[f"sin_{tag}"] = F.sin(F.col("_ep") * F.lit(speed))
            cols[f"cos_{tag}"] = F.cos(F.col("_ep") * F.lit(speed))
        return base.withColumns(cols), list(cols), []
    raise ValueError(f"unknown model {model!r}; expected one of {REGRESSION_MODELS}")


def _future_x(model: str, ep: np.ndarray, idx: np.ndarray, initial: np.ndarray, d: int, step: int,
              harmonics: tuple[int, int], changepoints: int, calendar: bool) -> np.ndarray:
    """Exogenous columns of the row d steps after the origin: the same
    definitions as the Spark columns, from the epoch and the position only."""
    e = ep + d * step
    if model == "arx":
        if not calendar:
            return np.ones((len(e), 1))
        hour, day = (e // 3600) % 24, (e // 86400 + 3) % 7  # 1970-01-01 was a Thursday; 0 = Monday
        out = np.zeros((len(e), 26))
        out[np.arange(len(e)), hour.astype(int)] = 1.0
        out[:, 24] = day >= 5
        out[:, 25] = (day - 3) / 2.0
        return out
    span = np.maximum(initial, 1).astype(float)
    cols = [np.ones(len(e)), (idx + d) / span - 0.5]
    cols += [np.maximum((idx + d) / span - j / (changepoints + 1.0), 0.0) for j in range(1, changepoints + 1)]
    for _, speed in _waves(harmonics):
        cols += [np.sin(e * speed), np.cos(e * speed)]
    return np.stack(cols, axis=1)


def solve_normal(gram: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residual sums of squares) of the last column on the
    given ones, for a stack of Gram matrices."""
    xx, xy, yy = gram[:, cols][:, :, cols], gram[:, cols, -1], gram[:, -1, -1]
    size = np.sqrt(np.einsum("bii->bi", xx))
    size = np.where(size > 0, size, 1.0)
    w, v = np.linalg.eigh(xx / (size[:, :, None] * size[:, None, :]))
    inv = np.where(w > RANK_CUT * np.maximum(w[:, -1:], 1e-300), 1.0 / np.where(w > 0, w, 1.0), 0.0)
    beta = np.einsum("bij,bj,bkj,bk->bi", v, inv, v, xy / size, optimize=True) / size
    rss = yy - 2 * np.einsum("bi,bi->b", beta, xy) + np.einsum("bi,bij,bj->b", beta, xx, beta)
    return beta, np.maximum(rss, 0.0)


def _unpack(flat: np.ndarray, m: int, live: list[tuple[int, int]]) -> np.ndarray:
    gram = np.zeros((len(flat), m, m))
    for n, (i, j) in enumerate(live):
        gram[:, i, j] = gram[:, j, i] = flat[:, n]
    return gram


def rolling_regression(series: DataFrame, model: str, granularity: str | Granularity,
                       h: int, step: int, initial_pct: int = 80, p_max: int = 3, pick: bool = True,
                       harmonics: tuple[int, int] = (3, 3), changepoints: int = 0,
                       calendar: bool = True, difference: bool = False, log: str | None = None,
                       on_short: str = "skip", chunk: int = CHUNK) -> DataFrame:
    """Per test row and fold: keys, fold, d, idx, ds, y, yhat.

    ``changepoints``: kinks of the trend, evenly spaced over the first
    training window; ``difference``: ``arx`` on y[t] - y[t-1], forecasts
    summed up from the last value; ``calendar=False``: intercept instead of
    the calendar columns; ``log``: fit in logs, results on the original scale.
    """
    if model not in REGRESSION_MODELS:
        raise ValueError(f"unknown model {model!r}; expected one of {REGRESSION_MODELS}")
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    order_max, difference = (p_max, difference) if model == "arx" else (0, False)
    rows = _lagged_rows(series, h, step, initial_pct, order_max, difference, log, on_short)
    tests = explode_folds(rows, {"f": (h, step)}, on_short).select(*K, "fold", "d", "idx", "ds", "y")
    rows = _scaled(rows, order_max, difference)
    df, exog, lags = _design(rows, model, order_max, harmonics, changepoints, calendar)
    z = [*exog, *lags, "_z"]
    m, n_exog = len(z), len(exog)
    # hour indicators are one-hot: their cross products are zero by
    # construction, so only the other entries of the Gram are summed
    onehot = {c for c in exog if c.startswith("hour_")}
    live = [(i, j) for i in range(m) for j in range(i, m)
            if i == j or not (z[i] in onehot and z[j] in onehot)]

    # A row adds to its block's Gram; the first row of block f + 1 is also
    # fold f's origin and goes to that fold as well.
    rel = F.col("idx") - F.col("initial")
    block = F.when(rel < 0, 0).otherwise(F.floor(rel / step) + 1).cast("long")
    origin = (rel >= 0) & (F.pmod(rel, F.lit(step)) == 0)
    parts = F.concat(F.array(F.struct(block.alias("fold"), F.lit(False).alias("o"))), F.when(origin, F.array(F.struct(
        F.floor(rel / step).cast("long").alias("fold"), F.lit(True).alias("o")))).otherwise(
        F.array().cast("array<struct<fold:bigint,o:boolean>>")))
    seen = df.withColumn("_p", F.explode(parts)).select("*", "_p.*").filter(F.col("fold") < F.col("n_folds"))
    # rows whose AR terms are not yet defined (the first of a series) carry no
    # equation
    whole_row = " AND ".join(f"`{c}` IS NOT NULL" for c in [*lags, "_z"])
    seen = seen.withColumn("_eq", F.expr(f"NOT o AND {whole_row}"))
    sums = ", ".join(f"coalesce(sum(CASE WHEN _eq THEN `{z[i]}` * `{z[j]}` END), 0D)" for i, j in live)
    fields = {"ep": "_ep", "idx": "idx", "initial": "initial", "c": "_c", "s": "_s", "last": "_last"}
    blocks = (seen.groupBy(*K, "fold").agg(
        F.expr(f"array({sums}) AS g"), F.count_if("_eq").cast("double").alias("cnt"),
        *[F.max(F.when(F.col("o"), F.col(c))).alias(n) for n, c in fields.items()],
        *[F.max(F.when(F.col("o"), F.col(c))).alias(f"_recent_{j}") for j, c in enumerate(lags, 1)])
        .withColumn("_chunk", F.floor(F.col("fold") / chunk).cast("long")))
    blocks, at = written(blocks, "gram-blocks")  # read by the totals, the order's choice and the solver
    size, again = len(live), blocks.sparkSession.read.parquet(at)  # columns of their own for the co-group
    totals = again.groupBy(*K, "_chunk").agg(
        F.expr("array(" + ", ".join(f"sum(g[{n}])" for n in range(size)) + ") AS g"))

    @pandas_udf("int")
    def choose(g0: pd.Series, n0: pd.Series) -> pd.Series:
        out = np.full(len(g0), order_max, np.int32)
        some = np.flatnonzero(g0.notna().to_numpy()) if pick and order_max else np.zeros(0, np.int64)
        if len(some):
            gram = _unpack(np.stack(g0.iloc[some].to_numpy()), m, live)
            n = np.maximum(n0.iloc[some].to_numpy(dtype=float), 1.0)
            floor = np.maximum(gram[:, -1, -1], 1e-300) * 1e-12
            aic = [n * np.log(np.maximum(solve_normal(gram, np.arange(n_exog + p))[1], floor) / n) + 2 * (n_exog + p)
                   for p in range(order_max + 1)]
            out[some] = np.argmin(np.stack(aic, 1), axis=1)
        return pd.Series(out)

    before = ("OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in K)
              + " ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    # the order, one row per series, rides along as chunk -1: no join
    orders = again.filter("fold = 0").select(*K, F.lit(-1).cast("long").alias("_chunk"), choose("g", "cnt").alias("p"))
    starts = (totals.unionByName(orders, allowMissingColumns=True)
              .select(*K, "_chunk", F.expr("array(" + ", ".join(
                  f"coalesce(sum(g[{n}]) {before}, 0D)" for n in range(size)) + ") AS g"),
                  F.max("p").over(Window.partitionBy(*K)).alias("p")).filter("_chunk >= 0"))
    names = [*K, "fold", "yhat"]

    def solve(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(start):
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values("fold")
        flat = np.cumsum(np.stack(pdf["g"].to_numpy()), axis=0) + np.asarray(start["g"].iloc[0])
        order = int(start["p"].iloc[0] or 0)
        beta, _ = solve_normal(_unpack(flat, m, live), np.arange(n_exog + order))
        ep, idx, initial = (pdf[c].to_numpy(dtype=np.int64) for c in ("ep", "idx", "initial"))
        c, s, level = (pdf[k].to_numpy(dtype=float) for k in ("c", "s", "last"))
        # z of the rows before the origin, newest first (lags of the origin row)
        hist = np.nan_to_num(np.stack([pdf[f"_recent_{j}"].to_numpy(dtype=float) for j in range(1, order + 1)], 1)
                             if order else np.zeros((len(pdf), 0)))
        out = np.empty((len(pdf), h))
        for d in range(h):
            x = _future_x(model, ep, idx, initial, d, g.seconds, harmonics, changepoints, calendar)
            value = np.einsum("bi,bi->b", x, beta[:, :n_exog]) + np.einsum("bi,bi->b", hist, beta[:, n_exog:])
            if order:
                hist = np.concatenate([value[:, None], hist[:, :-1]], axis=1)
            value = value * s + c
            level = level + value if difference else value
            out[:, d] = level
        keep = pdf[[*K, "fold"]].reset_index(drop=True)
        keep["yhat"] = list(out)
        return keep

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in K) + ", fold long, yhat array<double>"
    by = [*K, "_chunk"]
    pred = blocks.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(solve, schema)
    out = pair_by_fold(tests, pred)
    return out_of_logs(out, log)


def _lagged_rows(series: DataFrame, h: int, step: int, initial_pct: int, p: int, difference: bool,
                 log: str | None, on_short: str) -> DataFrame:
    """Rows with idx, n, initial, n_folds and the p (one more for differences)
    values before them, written once: by (series, chunk), no series window."""
    base, path = written(in_logs(series, log), "series")
    rows = fold_index(base, h, step, initial_pct, on_short=on_short, method="index")
    lags, w = p + 1 if p or difference else 0, inside_chunks(K)
    rows = without_copies(halo(rows, F.col("idx"), lags).withColumns(
        {f"_y{j}": F.lag("y", j).over(w) for j in range(1, lags + 1)})) if lags else rows
    out, _ = written(rows, "lagged")
    forget(base.sparkSession, path)
    return out


def _scaled(rows: DataFrame, p: int, difference: bool) -> DataFrame:
    """_z, the target centred and scaled by its first training window, its
    lags, _last and _ep. The statistics, one row per series, meet the rows by
    (series, chunk), so a long series' rows are not brought together."""
    value = [F.col("y"), *[F.col(f"_y{j}") for j in range(1, p + 2 if p or difference else 1)]]
    target = [value[j] - value[j + 1] for j in range(p + 1)] if difference else value
    rows = rows.withColumns({"_t": target[0], "_at": F.floor(F.col("idx") / CHUNK_ROWS).cast("long"),
                             "_last": value[1] if len(value) > 1 else F.lit(None).cast("double")})
    early = F.when(F.col("idx") < F.col("initial"), F.col("_t"))
    stats = rows.groupBy(*K).agg(F.avg(early).alias("_c"), F.stddev_pop(early).alias("_s"),
                                 F.max("idx").alias("_top"))
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_top") / CHUNK_ROWS).cast("long")))
    stats = stats.select(*K, places.alias("_at"), (F.lit(0.0) if difference else F.coalesce("_c", F.lit(0.0))).alias("_c"),
                         F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("_s"))
    rows = attach(rows, stats, [*K, "_at"]).drop("_at")
    scaled = {"_z": (F.col("_t") - F.col("_c")) / F.col("_s"), "_ep": epoch_seconds("ds")}
    scaled.update({f"_lag_{j}": (target[j] - F.col("_c")) / F.col("_s") for j in range(1, p + 1)})
    return rows.withColumns(scaled)


def pair_by_fold(tests: DataFrame, pred: DataFrame) -> DataFrame:
    """Test rows with their fold's forecasts: an inner join on (keys, fold),
    each fold's forecasts being one array, and the row's place in it. The
    fold means after it are keyed by the same columns and move nothing."""
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in K] + [F.col("t.fold") == F.col("p.fold")]
    return (tests.alias("t").join(pred.alias("p"), on)
            .select(*[F.col(f"t.{c}").alias(c) for c in (*K, "fold", "d", "idx", "ds", "y")],
                    F.get(F.col("p.yhat"), F.col("t.d").cast("int")).alias("yhat")))
