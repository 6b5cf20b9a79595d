"""Put each series on a regular tick grid and fill missing ticks (F1, F2,
J1, J2, P5, P6, P8).

Two physical plans with identical results:

``method="window"`` (default)
    one pass over each series ordered by ``ds``: every on-grid observation
    emits itself plus the fill ticks up to the next observation
    (``lead`` + ``explode(sequence)``). No join; one shuffle by series key,
    and the lag / moving-average / rank windows that usually follow reuse
    that same partitioning, so a whole feature pipeline costs one exchange
    after the rollup.
``method="join"``
    per-series bounds (a tiny aggregate) -> explode the tick grid -> left
    (or full) equi-join with the observations on (keys, ds). The join is
    keyed by ``ds`` too, so one very long series is spread over all
    partitions; use it when a single series is too long for one task.

Semantics (both plans): the grid runs from ``start`` to ``end`` inclusive in
steps of the granularity; ``start`` is the series' first observation
(``anchor="min"``) or ``from_date`` (``anchor="from_date"``, observations
before it are dropped first); ``end`` is ``to_date`` or the series' last
observation. A series has its grid as soon as it has an observation in range,
on the grid or not; with ``series`` (a table of keys, and of a ``start`` if
its grids begin elsewhere) also those have it that have none, up to
``to_date``. An observation is on the grid if it lies a whole number of steps
after ``start``, to the microsecond; others are dropped (``off_grid="drop"``)
or kept with a null ``ds`` and ``on_grid = false`` (``off_grid="keep"``).
Duplicate observations at one tick are all kept. Missing ticks and null
values get ``fill``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.time import epoch_micros, from_epoch_micros, range_filter, ts_lit
from gridcast.schema import FILL_VALUE, KEYS, Granularity


def resample(obs: DataFrame, granularity: str | Granularity = "one_hour",
             to_date: str | None = None, from_date: str | None = None,
             anchor: str = "min", off_grid: str = "drop", fill: float = FILL_VALUE,
             keys: Sequence[str] = KEYS, method: str = "window",
             series: DataFrame | None = None) -> DataFrame:
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    if anchor not in ("min", "from_date"):
        raise ValueError(f"unknown anchor {anchor!r}")
    if off_grid not in ("drop", "keep"):
        raise ValueError(f"unknown off_grid policy {off_grid!r}")
    if method not in ("window", "join"):
        raise ValueError(f"unknown method {method!r}")
    keys = list(keys)
    # Rows past the end never reach the grid; rows before from_date are out
    # of range on the from_date anchor.
    start = from_date if anchor == "from_date" else None
    obs = range_filter(obs.select(*keys, "ds", "y"), start, to_date).filter(F.col("ds").isNotNull())
    rows = obs.select(*keys, "y", epoch_micros("ds").alias("_us"), F.lit(None).cast("long").alias("_own"))
    if series is not None:
        own = epoch_micros("start") if "start" in series.columns else F.lit(None).cast("long")
        rows = rows.unionByName(series.select(
            *keys, F.lit(None).cast("double").alias("y"), F.lit(None).cast("long").alias("_us"), own.alias("_own")))
    first = F.coalesce(epoch_micros(ts_lit(start)) if start else F.lit(None).cast("long"), F.col("_st"))
    last = epoch_micros(ts_lit(to_date)) if to_date else F.col("_en")
    run = _by_window if method == "window" else _by_join
    out = run(rows, g.seconds * 1_000_000, first, last, off_grid, fill, keys)
    out = out.select(*keys, from_epoch_micros("_us").alias("ds"), "y", "on_grid")
    return out if off_grid == "keep" else out.drop("on_grid")


def _off_rows(x: DataFrame, fill: float, keys: list[str]) -> DataFrame:
    return x.select(*keys, F.lit(None).cast("long").alias("_us"), F.coalesce("y", F.lit(fill)).alias("y"),
                    F.lit(False).alias("on_grid"))


def _by_window(rows, step, first, last, off_grid, fill, keys):
    ordered = Window.partitionBy(*keys).orderBy("_us")
    # bounds over the whole series, but on the same ordering as the lead /
    # row_number windows below: one sort of the series serves them all (the
    # filter in between keeps the order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = rows.withColumns({"_st": F.coalesce(F.max("_own").over(whole), F.min("_us").over(whole)),
                          "_en": F.max("_us").over(whole), "_n": F.row_number().over(ordered)})
    x = x.withColumns({"_st": first, "_en": last})
    x = x.withColumn("on_grid", F.coalesce((F.col("_us") >= F.col("_st")) & (F.pmod(F.col("_us") - F.col("_st"), F.lit(step)) == 0),
                                           F.lit(False)))
    # a series without an observation on the grid has its ticks from its first row
    x = x.withColumn("_bare", ~F.max("on_grid").over(whole) & (F.col("_n") == 1))
    on = x.filter(F.col("on_grid") | F.col("_bare"))
    on = on.withColumn("_at", F.when(F.col("_bare"), F.col("_st")).otherwise(F.col("_us")))
    nxt = F.lead("_at").over(ordered)
    head = F.row_number().over(ordered) == 1
    pre = F.when(head, F.floor((F.col("_at") - F.col("_st")) / step)).otherwise(0).cast("long")
    gap = F.coalesce(F.floor((nxt - F.col("_at")) / step) - 1, F.floor((F.col("_en") - F.col("_at")) / step)).cast("long")
    on = on.withColumns({"_pre": pre, "_gap": F.when(F.col("_bare"), gap).otherwise(F.greatest(gap, F.lit(0)))})
    on = on.filter((F.col("_gap") >= 0)).select(
        *keys, "y", "_at", "_bare", F.explode(F.sequence(-F.col("_pre"), F.col("_gap"))).alias("_k"))
    value = F.when((F.col("_k") == 0) & ~F.col("_bare"), F.coalesce("y", F.lit(fill))).otherwise(F.lit(fill))
    grid = on.select(*keys, (F.col("_at") + F.col("_k") * step).alias("_us"), value.alias("y"), F.lit(True).alias("on_grid"))
    if off_grid == "drop":
        return grid
    return grid.unionByName(_off_rows(x.filter(~F.col("on_grid") & F.col("_us").isNotNull()), fill, keys))


def _by_join(rows, step, first, last, off_grid, fill, keys):
    bounds = (rows.groupBy(*keys).agg(F.coalesce(F.max("_own"), F.min("_us")).alias("_st"), F.max("_us").alias("_en"))
              .withColumns({"_st": first, "_en": last}).filter(F.col("_st") <= F.col("_en")))
    grid = bounds.select(*keys, F.explode(F.sequence("_st", "_en", F.lit(step).cast("long"))).alias("_us"))
    obs = rows.filter(F.col("_us").isNotNull()).select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_us").alias("_o_us"), "y",
                                                       F.lit(True).alias("_is"))
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys] + [F.col("_us") == F.col("_o_us")]
    j = grid.join(obs, same, "left" if off_grid == "drop" else "full")
    return j.select(*[F.when(F.col("_us").isNotNull(), F.col(k)).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys],
                    "_us", F.coalesce("y", F.lit(fill)).alias("y"), F.col("_us").isNotNull().alias("on_grid"))
