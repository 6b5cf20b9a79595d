"""Long series without a series window: rows are dealt by (series, chunk).

* :func:`position_index`: row number and row count of each series as a
  two-level index: rows are counted per (series, time bucket), the buckets'
  counts give each bucket's offset, and rows are numbered inside their bucket.
  Only the bucket counts (one row per bucket) are ordered per series.
* :func:`halo`: rows dealt by (series, chunk of positions), each chunk with
  the last ``width`` rows of the chunk before it, so that lags, trailing means
  and differences are windows inside a chunk. Only ``width`` rows per chunk
  are copied, not every row.

Results equal those of the windows over whole series: a lag or mean reads the
same rows in the same order. Equal ``ds`` are numbered in no fixed order, as
by ``row_number``. Rows with a null ``ds`` come first, null keys are a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.functions.time import epoch_micros, epoch_seconds
from gridcast.schema import KEYS, Granularity

#: seconds of a time bucket of the index (a week: 10,080 rows at one minute)
BUCKET = 7 * 86400
#: positions of a chunk
CHUNK = 4096


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of ``left``'s columns and ``right``'s, called ``_r_<name>``."""
    on = F.lit(True)
    for c in names:
        on = on & left[c].eqNullSafe(right[f"_r_{c}"])
    return on


def attach(rows: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``table``, whose rows are one per
    value of ``names`` (nulls are values); inner join."""
    right = table.select(*[F.col(c).alias(f"_r_{c}") for c in names], *[c for c in table.columns if c not in names])
    return rows.join(right, same_keys(rows, right, names)).drop(*[f"_r_{c}" for c in names])


def position_index(df: DataFrame, keys: Sequence[str] = KEYS, bucket: int = BUCKET) -> DataFrame:
    """Add ``idx`` (row number from 0 by ``ds``) and ``n`` (rows of the
    series). ``df`` is read twice: give a stored table, not a long plan."""
    keys = list(keys)
    slot = F.floor(epoch_seconds("ds") / bucket).cast("long")
    x = df.withColumn("_slot", F.coalesce(slot, F.lit(-(1 << 40))))
    counts = x.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy(*keys)
    before = series.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(series).alias("n"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("ds")
    x = x.withColumn("_own", F.row_number().over(inside) - 1)
    return (attach(x, offsets, [*keys, "_slot"])
            .withColumn("idx", (F.col("_before") + F.col("_own")).cast("long"))
            .select(*df.columns, "idx", F.col("n").cast("long").alias("n")))


def tick(granularity: str | Granularity) -> Column:
    """Position of a row on a gap-free grid, counted from 1970: it needs no
    look at other rows."""
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    return F.floor(epoch_micros("ds") / (g.seconds * 1_000_000)).cast("long")


def halo(df: DataFrame, position: Column, width: int, chunk: int = CHUNK) -> DataFrame:
    """``df`` with ``_pos``, ``_chunk`` and ``_copy``: every row in its
    chunk, and the last ``width`` of a chunk again in the next one."""
    if not 0 <= width <= chunk:
        raise ValueError(f"a halo of {width} rows does not fit a chunk of {chunk}")
    own = F.floor(F.col("_pos") / chunk).cast("long")
    here = F.struct(own.alias("_chunk"), F.lit(False).alias("_copy"))
    there = F.struct((own + 1).alias("_chunk"), F.lit(True).alias("_copy"))
    late = F.col("_pos") - own * chunk >= chunk - width
    return (df.withColumn("_pos", position).withColumn("_h", F.explode(F.when(late, F.array(here, there)).otherwise(F.array(here))))
            .select("*", "_h.*").drop("_h"))


def inside_chunks(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys, "_chunk").orderBy("_pos")


def without_copies(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_copy")).drop("_copy", "_chunk", "_pos")


def halo_features(df: DataFrame, lags: int = 0, mean: int = 0, col: str = "y", keys: Sequence[str] = KEYS,
                  granularity: str | Granularity | None = None, difference: int = 0, chunk: int = CHUNK) -> DataFrame:
    """lag_1 .. lag_n, avg_n (mean of the n rows before) and diff_n
    (value minus the n-th before) of ``col``, inside chunks.

    With ``granularity`` the rows must be a gap-free grid without repeated
    ticks (the output of ``resample``): one shuffle, by (keys, chunk). Without
    it positions come from :func:`position_index` and any rows will do.
    """
    if granularity is None:
        x, position = position_index(df, keys), F.col("idx")
    else:
        x, position = df, tick(granularity)
    w = inside_chunks(keys)
    new = {f"lag_{i}": F.lag(col, i).over(w) for i in range(1, lags + 1)}
    if mean:
        new[f"avg_{mean}"] = F.avg(col).over(w.rowsBetween(-mean, -1))
    if difference:
        new[f"diff_{difference}"] = F.col(col) - F.lag(col, difference).over(w)
    out = without_copies(halo(x, position, max(lags, mean, difference), chunk).withColumns(new))
    return out.select(*df.columns, *new)
