"""Tumbling-window rollup of raw measurements into observations.

Observations carry ``ds`` = the window **end**, ``y`` = mean value, and the
additive pair (``n``, ``total``) so coarser rollups can be derived exactly.

Scale: ``groupBy(keys, window)`` aggregates partially on the map side and
shuffles on (keys, window); a hot series is spread over its windows, so no
task ever holds a whole raw series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.time import range_filter
from gridcast.schema import KEYS, Granularity


def _gran(g: str | Granularity) -> Granularity:
    return g if isinstance(g, Granularity) else Granularity.of(g)


def rollup_batch(raw: DataFrame, granularity: str | Granularity = "one_hour",
                 keys: tuple[str, ...] = KEYS, ts: str = "ts",
                 value: str = "value", from_date: str | None = None,
                 to_date: str | None = None) -> DataFrame:
    """``from_date`` and ``to_date`` bound ``ds`` (both included). A window
    ends one step after it starts, so the same bounds, one step earlier below,
    go to the raw ``ts`` as well: they reach the scan, and every window in
    range still gets all its rows."""
    g = _gran(granularity)
    if from_date is not None:
        raw = raw.filter(F.col(ts) >= F.lit(from_date).cast("timestamp_ntz") - F.expr(f"INTERVAL {g.seconds} SECONDS"))
    if to_date is not None:
        raw = raw.filter(F.col(ts) < F.lit(to_date).cast("timestamp_ntz"))
    agg = (raw.groupBy(*keys, F.window(ts, g.interval).alias("w"))
           .agg(F.avg(value).alias("y"), F.count(value).alias("n"),
                F.sum(value).alias("total")))
    out = agg.select(*keys, F.col("w.end").alias("ds"), "y", "n", "total")
    return range_filter(out, from_date, to_date)


def series_starts(raw: DataFrame, granularity: str | Granularity = "one_hour",
                  keys: tuple[str, ...] = KEYS, ts: str = "ts") -> DataFrame:
    """keys and ``start``, the end of the series' first window: one pass over
    keys and time only, one row per series."""
    g = _gran(granularity)
    first = raw.groupBy(*keys).agg(F.min(ts).alias("_first"))
    return (first.withColumn("_w", F.window("_first", g.interval))
            .select(*keys, F.col("_w.end").alias("start")))


def rollup_coarsen(obs: DataFrame, granularity: str | Granularity,
                   keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Roll finer observations up to ``granularity`` from (n, total).

    ``ds`` is a window end, so the observation belongs to the window that
    contains ``ds - 1 microsecond``.
    """
    g = _gran(granularity)
    inner = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("ds"))
    agg = (obs.groupBy(*keys, F.window(inner, g.interval).alias("w"))
           .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    return agg.select(*keys, F.col("w.end").alias("ds"),
                      (F.col("total") / F.col("n")).alias("y"), "n", "total")
