"""Column expressions on the time column (all time-zone independent).

``ds`` is TIMESTAMP_NTZ throughout; epoch arithmetic uses calendar fields
and ``timestamp_add``, so no session time zone can shift a tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _epoch_days(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")


def epoch_seconds(col: str | Column = "ds") -> Column:
    """TIMESTAMP_NTZ -> whole seconds since 1970-01-01 00:00 (bigint).

    Built from the calendar fields: ``timestamp_diff`` on TIMESTAMP_NTZ goes
    through the session time zone and loses an hour in a DST gap.
    """
    c = _c(col)
    return (_epoch_days(c) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
            + F.second(c)).cast("long")


def epoch_micros(col: str | Column = "ts") -> Column:
    """TIMESTAMP_NTZ -> microseconds since 1970-01-01 00:00 (bigint)."""
    c = _c(col)
    whole = _epoch_days(c) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def from_epoch_micros(col: str | Column) -> Column:
    """Microseconds since 1970-01-01 00:00 -> TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(col), _epoch())


def from_epoch_seconds(col: str | Column) -> Column:
    """Seconds since 1970-01-01 00:00 -> TIMESTAMP_NTZ."""
    return F.timestamp_add("SECOND", _c(col), _epoch())


def shift(col: str | Column, seconds: int | Column) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", s, _c(col))


def hour_of_day(col: str | Column = "ds") -> Column:
    return F.hour(_c(col))


def weekend_sat_sun(col: str | Column = "ds") -> Column:
    """1 on Saturday and Sunday (dayofweek 7 and 1), else 0."""
    return F.dayofweek(_c(col)).isin(1, 7).cast("int")


def week_day(col: str | Column = "ds") -> Column:
    """Day of week, 0 = Monday .. 6 = Sunday."""
    return F.weekday(_c(col))


def ts_lit(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def range_filter(df: DataFrame, from_date: str | None = None,
                 to_date: str | None = None, col: str = "ds") -> DataFrame:
    """Both ends included; ``None`` = unbounded. On a stored ``ds`` the bounds
    reach the scan; on the output of a rollup they stay above it, so give them
    to ``rollup_batch`` instead."""
    if from_date is not None:
        df = df.filter(F.col(col) >= ts_lit(from_date))
    if to_date is not None:
        df = df.filter(F.col(col) <= ts_lit(to_date))
    return df
