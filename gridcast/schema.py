"""Data model: series keys, granularities, forecast horizons, schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType, TimestampNTZType)

# A series is identified by these three columns; every window, grouping and
# join of the library is keyed by them (never an un-keyed window).
KEYS: tuple[str, ...] = ("name", "unique_id", "id_object")

OBSERVATION_SCHEMA = StructType([
    StructField("name", StringType()),
    StructField("unique_id", StringType()),
    StructField("id_object", IntegerType()),
    StructField("ds", TimestampNTZType()),
    StructField("y", DoubleType()),
])

# The value a missing tick gets after gap filling, and the
# metric columns every evaluation returns.
FILL_VALUE = 0.1
METRIC_COLUMNS = ("mape_low", "mape", "mape_high", "rmse", "mse", "mae")


@dataclass(frozen=True)
class Granularity:
    name: str
    seconds: int
    freq: str  # horizon-table column

    # The granularities observations are rolled up to.
    @staticmethod
    def of(name: str) -> "Granularity":
        try:
            return _GRANULARITIES[name]
        except KeyError:
            raise ValueError(f"unknown granularity {name!r}; "
                             f"expected one of {sorted(_GRANULARITIES)}") from None

    @property
    def interval(self) -> str:
        return f"{self.seconds} seconds"


_GRANULARITIES = {
    "one_minute": Granularity("one_minute", 60, "1min"),
    "fifteen_minute": Granularity("fifteen_minute", 900, "15min"),
    "one_hour": Granularity("one_hour", 3600, "1h"),
    "one_day": Granularity("one_day", 86400, "1d"),
}

# Rolling-origin horizon h and origin step, per forecast kind
# and granularity frequency, as (h, step). one_day only has the 1_step entry.
HORIZONS: dict[str, dict[str, tuple[int, int]]] = {
    "1_step": {"1min": (1, 1), "15min": (1, 1), "1h": (1, 1), "1d": (1, 1)},
    "1_hour": {"1min": (60, 60), "15min": (4, 4), "1h": (1, 1)},
    "12_hour": {"1min": (720, 60), "15min": (48, 4), "1h": (12, 1)},
}


def horizon(forecast: str, granularity: str | Granularity) -> tuple[int, int]:
    g = granularity if isinstance(granularity, Granularity) else Granularity.of(granularity)
    try:
        return HORIZONS[forecast][g.freq]
    except KeyError:
        raise ValueError(f"no horizon {forecast!r} for granularity {g.name!r}") from None


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
