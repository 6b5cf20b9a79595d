"""Closed forms of linear recursions used by the forecasters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ar1_ahead(a: Column, b: Column, last: Column, steps: Column) -> Column:
    """``x <- a + b x`` applied ``steps`` times to ``last``, in O(1):
    b^k last + a (1 - b^k) / (1 - b), k = steps (a + ... = a k when b = 1).

    Near b = 1 the geometric factor uses expm1 / log1p, so it keeps full
    precision where (1 - b^k) / (1 - b) would cancel; b - 1 is exact there.
    Denominators are guarded, so no branch ever divides by zero (ANSI).
    Null coefficients or a null start give null, as the iteration would.
    """
    k = steps.cast("double")
    bm1 = b - F.lit(1.0)
    near = (b > 0) & (F.abs(bm1) < 0.5)
    safe = F.when(bm1 == 0, F.lit(1.0)).otherwise(bm1)
    bk = F.when(near, F.exp(k * F.log1p(bm1))).otherwise(F.pow(b, k))
    geo = (F.when(bm1 == 0, k)
           .when(near, F.expm1(k * F.log1p(bm1)) / safe)
           .otherwise((bk - F.lit(1.0)) / safe))
    return bk * last + a * geo
