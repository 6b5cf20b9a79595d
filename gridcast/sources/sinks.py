"""Result sinks (S3, S5, J4): metrics and predictions are ordinary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from gridcast.schema import KEYS

METRIC_PARTITIONS = ("model", "granularity", "forecast")


def write_metrics(metrics: DataFrame, path: str,
                  partition_by: Sequence[str] = METRIC_PARTITIONS) -> None:
    """One row per (series, model, granularity, forecast); re-running one
    configuration replaces only its partitions."""
    (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*[c for c in partition_by if c in metrics.columns]).parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def align_predictions(predictions: DataFrame, actual: DataFrame,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Pair forecasts with actual values by (keys, ds), never by position."""
    return predictions.join(actual.select(*keys, "ds", "y"), list(keys) + ["ds"], "inner")


def predictions_table(df: DataFrame, keys: Sequence[str] = KEYS,
                      extra: Sequence[str] = ()) -> DataFrame:
    """Long actual-versus-forecast table: keys, ds, y, yhat (+ extra)."""
    return df.select(*keys, *extra, "ds", "y", "yhat")


def write_predictions(df: DataFrame, path: str,
                      partition_by: Sequence[str] = METRIC_PARTITIONS) -> None:
    write_metrics(df, path, partition_by)

