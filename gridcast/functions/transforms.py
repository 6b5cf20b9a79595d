"""Target transforms and their inverses (F8-F10), always used as a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FORWARD = {"log1p": F.log1p, "log": F.ln}
_INVERSE = {"log1p": F.expm1, "log": F.exp}


def log_transform(df: DataFrame, kind: str = "log1p", col: str = "y",
                  check: bool = False) -> DataFrame:
    """Replace ``col`` by log1p(col) or ln(col).

    ``ln`` of a value <= 0 is null in Spark; with ``check=True`` such rows
    raise at run time instead (``raise_error`` inside the plan, no action).
    """
    if kind not in _FORWARD:
        raise ValueError(f"unknown log kind {kind!r}")
    value = F.col(col)
    if check:
        bound = -1.0 if kind == "log1p" else 0.0
        value = F.when(value > bound, value).otherwise(
            F.raise_error(F.lit(f"{kind} of a value <= {bound} in column {col}")))
    return df.withColumn(col, _FORWARD[kind](value))


def inverse_transform(df: DataFrame, kind: str = "log1p",
                      cols: tuple[str, ...] = ("y", "prediction")) -> DataFrame:
    if kind not in _INVERSE:
        raise ValueError(f"unknown log kind {kind!r}")
    return df.withColumns({c: _INVERSE[kind](F.col(c)) for c in cols if c in df.columns})
