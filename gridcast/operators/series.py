"""Series selection and counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.schema import KEYS


def _typed(df: DataFrame, col: str, value: str):
    """A key value as a literal of the column's type."""
    return F.lit(str(value)).cast(df.schema[col].dataType)


def select_series(df: DataFrame, key: Mapping[str, object] | Sequence[Mapping[str, object]],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Keep one series (a mapping) or many (a list of mappings, all over the
    same columns).

    Values are cast to the column's type once, whatever they are given as. A
    mapping is an equality predicate. A list, of any length, is a semi-join
    with the typed literal table of its keys (Spark broadcasts it if small),
    under the predicate that each column holds one of the listed values:
    both reach the parquet scan as pushed filters.
    """
    keys = [key] if isinstance(key, Mapping) else list(key)
    if not keys:
        raise ValueError("empty key list")
    names = list(keys[0])
    if any(set(k) != set(names) for k in keys):
        raise ValueError("the keys of one selection must have the same columns")
    out = df
    for c in names:
        listed = list(dict.fromkeys(str(_present(c, k[c])) for k in keys))
        typed = [_typed(df, c, v) for v in listed]
        out = out.filter(F.col(c) == typed[0] if len(typed) == 1 else F.col(c).isin(typed))
    if not isinstance(key, Mapping):
        literal = df.sparkSession.createDataFrame(
            [tuple(str(k[c]) for c in names) for k in keys], ", ".join(f"`{c}` string" for c in names))
        literal = literal.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in names]).distinct()
        out = out.join(literal, names, "left_semi")
    return out.select(*columns) if columns else out


def _present(col: str, value: object) -> object:
    if value is None:
        raise ValueError(f"no value for key column {col!r}")
    return value


def series_counts(df: DataFrame, keys: Sequence[str] = KEYS,
                  count_col: str = "n_obs") -> DataFrame:
    """Rows per series, largest first (A2, O2)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.desc(count_col), *keys))


def select_time_series(df: DataFrame, min_observations: int,
                       keys: Sequence[str] = KEYS, method: str = "window") -> DataFrame:
    """Keep series with strictly more than ``min_observations`` rows.

    ``method="window"`` (default): a count over ``partitionBy(keys)`` and a
    filter: one pass and one shuffle by series key, which later series
    windows reuse. Meant for observation tables, where a series holds at
    most span / granularity rows.
    ``method="semi_join"``: grouped count (map-side partial) + semi-join,
    for raw tables whose hot keys must not land in one task: AQE broadcasts
    the one-row-per-series side once measured small, or splits skewed
    partitions of the big side. It reads ``df`` twice.
    """
    keys = list(keys)
    if method == "window":
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).filter(F.col("_n") > min_observations).drop("_n")
    if method != "semi_join":
        raise ValueError(f"unknown method {method!r}")
    qualifying = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > min_observations).select(*keys))
    return df.join(qualifying, keys, "left_semi")


def count_series(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of distinct series, as a one-row DataFrame (A4)."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_series"))
