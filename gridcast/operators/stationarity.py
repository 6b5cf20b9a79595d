"""Order of differencing per series, by the KPSS statistic (M5).

A series is level-stationary if eta = sum of S_t^2 / (n^2 s^2) stays under a
critical value, S_t being the running sum of the values about their mean and
s^2 their long-run variance with Bartlett weights over
l = floor(4 (n / 100)^(1/4)) lags. The order is the first of 0 to ``max_order``
whose differences pass, else ``max_order``.

All orders of all series are taken in one plan: rows are numbered by the
two-level index and get their differences and lagged products inside overlapping
chunks; running sums are sums inside chunks plus offsets of the chunks; the
rest are grouped sums. No window is over a series' rows.

A constant series has eta 0; one with fewer than three values at an order has
none (null) and passes. Null values are left out of the sums as rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.operators.chunked import CHUNK, attach, halo, inside_chunks, position_index, without_copies
from gridcast.schema import KEYS
from gridcast.session import written

#: fixed values: critical values of the level statistic by significance
CRITICAL = {0.1: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}


def differences(df: DataFrame, max_order: int, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """keys, ds, idx and _d0 .. _dk: the values and their differences."""
    rows = position_index(df.select(*keys, "ds", "y").filter(F.col("y").isNotNull()), keys).drop("n")
    w = inside_chunks(keys)
    out = halo(rows, F.col("idx"), max_order, chunk)
    lags = [F.col("y"), *[F.lag("y", j).over(w) for j in range(1, max_order + 1)]]
    new = {f"_d{d}": sum((-1) ** j * math.comb(d, j) * lags[j] for j in range(d + 1)) for d in range(max_order + 1)}
    return without_copies(out.withColumns(new)).drop("y")


def kpss(df: DataFrame, max_order: int = 2, keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """keys, order, n, lags, statistic (eta) for every order up to ``max_order``."""
    by = [*keys, "order"]
    stacked = F.explode(F.array(*[F.struct(F.lit(d).alias("order"), F.col(f"_d{d}").alias("v")) for d in range(max_order + 1)]))
    rows = differences(df, max_order, keys, chunk).select(*keys, "idx", stacked.alias("s")).select(*keys, "idx", "s.*")
    rows, _ = written(rows.filter(F.col("v").isNotNull()), "kpss-rows")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("idx").alias("top"))
    stats = stats.withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(0.25))).cast("int"))
    stats, _ = written(stats, "kpss-stats")
    most = stats.agg(F.max("lags")).first()[0] or 0
    # one row per series and order, met by (series, order, chunk)
    spread = stats.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / chunk).cast("long"))))
    x = attach(rows.withColumn("_at", F.floor(F.col("idx") / chunk).cast("long")), spread.select(*by, "_at", "mean", "lags"), [*by, "_at"])
    x = x.withColumn("e", F.col("v") - F.col("mean")).drop("_at", "v", "mean")
    own = inside_chunks(by)
    x = halo(x, F.col("idx"), most, chunk)
    # only the chunk's own rows count in its running sum
    x = x.withColumn("_in", F.sum(F.when(~F.col("_copy"), F.col("e")).otherwise(0.0)).over(
        own.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumns({f"_p{j}": F.col("e") * F.lag("e", j).over(own) for j in range(1, most + 1)}).filter(~F.col("_copy"))
    # sum of (offset + inside)^2 from sums of a chunk: no running sum over chunks' rows
    parts = x.groupBy(*by, "_chunk").agg(
        F.sum("e").alias("_e"), F.sum(F.col("_in") * F.col("_in")).alias("_i2"), F.sum("_in").alias("_i"),
        F.count(F.lit(1)).alias("_m"), F.sum(F.col("e") * F.col("e")).alias("_p0"),
        *[F.sum(f"_p{j}").alias(f"_p{j}") for j in range(1, most + 1)])
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_o", F.coalesce(F.sum("_e").over(before), F.lit(0.0)))
    sums = parts.groupBy(*by).agg(
        F.sum(F.col("_i2") + 2 * F.col("_o") * F.col("_i") + F.col("_m") * F.col("_o") * F.col("_o")).alias("_s2"),
        *[F.coalesce(F.sum(f"_p{j}"), F.lit(0.0)).alias(f"_p{j}") for j in range(most + 1)])
    x = attach(sums, stats.select(*by, "n", "lags"), by)
    long_run = F.col("_p0") + 2 * sum(
        (F.greatest(1 - F.lit(float(j)) / (F.col("lags") + 1), F.lit(0.0)) * F.col(f"_p{j}") for j in range(1, most + 1)), F.lit(0.0))
    n = F.col("n").cast("double")
    eta = F.when(n >= 3, F.when(F.col("_p0") > 0, F.col("_s2") / (n * long_run)).otherwise(0.0))
    return x.select(*by, F.col("n").cast("long").alias("n"), "lags", eta.alias("statistic"))


def difference_order(df: DataFrame, max_order: int = 2, significance: float = 0.05,
                     keys: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """keys, order and the statistics of all orders (statistic_0, ...)."""
    limit = CRITICAL[significance]
    tests = kpss(df, max_order, keys, chunk)
    wide = tests.groupBy(*keys).agg(*[F.max(F.when(F.col("order") == d, F.col("statistic"))).alias(f"statistic_{d}")
                                      for d in range(max_order + 1)])
    order = F.lit(max_order)
    for d in range(max_order - 1, -1, -1):
        passed = F.coalesce(F.col(f"statistic_{d}") <= limit, F.lit(True))
        order = F.when(passed, F.lit(d)).otherwise(order)
    return wide.withColumn("order", order)


def difference_series(df: DataFrame, orders: DataFrame, max_order: int = 2, keys: Sequence[str] = KEYS,
                      chunk: int = CHUNK) -> DataFrame:
    """keys, ds, order, y: each series differenced as often as ``orders``
    says; its first values, which have no difference, go."""
    rows = differences(df, max_order, keys, chunk).withColumn("_at", F.floor(F.col("idx") / chunk).cast("long"))
    tops = rows.groupBy(*keys).agg(F.max("_at").alias("_top"))
    spread = (attach(tops, orders.select(*keys, "order"), list(keys))
              .withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top")))).drop("_top"))
    x = attach(rows, spread, [*keys, "_at"])
    value = F.lit(None).cast("double")
    for d in range(max_order + 1):
        value = F.when(F.col("order") == d, F.col(f"_d{d}")).otherwise(value)
    return x.withColumn("y", value).filter(F.col("y").isNotNull()).select(*keys, "ds", "order", "y")
