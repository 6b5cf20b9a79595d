"""Forecast error metrics (A5-A8), each one grouped aggregate.

Partial aggregation runs map-side, so a metric over billions of rows
shuffles one small row per (group, map task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.schema import KEYS


def percent_error(y: Column, yhat: Column, zero: str = "inf") -> Column:
    """|y - yhat| / |y| * 100.

    ``zero="inf"``: y = 0 gives +inf (NaN when yhat is 0 too), as a plain
    float division would; ``zero="skip"``: null, so aggregates ignore it.
    Spark's ANSI mode raises on a zero divisor, hence the explicit branch.
    """
    err = y - yhat
    if zero == "inf":
        at_zero = F.when(err == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    elif zero == "skip":
        at_zero = F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown zero policy {zero!r}")
    return F.when(y != 0, F.abs(err / y) * 100).otherwise(at_zero)


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat",
                       by: Sequence[str] = KEYS, zero: str = "inf") -> DataFrame:
    """mape_low, mape, mape_high (percent), rmse, mse, mae and n per group."""
    err = F.col(y) - F.col(yhat)
    pe = percent_error(F.col(y), F.col(yhat), zero)
    return (df.groupBy(*by)
            .agg(F.min(pe).alias("mape_low"), F.avg(pe).alias("mape"), F.max(pe).alias("mape_high"),
                 F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("rmse", F.sqrt("mse")))


def fold_means(df: DataFrame, y: str = "y", yhat: str = "yhat",
               by: Sequence[str] = KEYS) -> DataFrame:
    """Per fold: mean actual, mean forecast over its h test rows, and the
    last test ``ds`` as the fold's label (A8)."""
    return (df.groupBy(*by, "fold")
            .agg(F.max("ds").alias("ds"), F.avg(y).alias("y"), F.avg(yhat).alias("yhat")))


def fold_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat",
                 by: Sequence[str] = KEYS, level: str = "fold", zero: str = "inf") -> DataFrame:
    """Rolling-origin errors: on per-fold means (``level="fold"``, the
    default) or on every test point (``level="point"``)."""
    if level == "fold":
        return regression_metrics(fold_means(df, y, yhat, by), "y", "yhat", by, zero)
    if level == "point":
        return regression_metrics(df, y, yhat, by, zero)
    raise ValueError(f"unknown level {level!r}")
