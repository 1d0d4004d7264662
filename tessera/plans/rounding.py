"""The same rounding in both engines, for sums that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r(c: Column, scale: float = 1e4) -> Column:
    """Rounded to 1/scale."""
    return F.floor(c * scale + 0.5) / scale


def R(expression: str, scale: float = 1e4) -> str:  # noqa: N802
    """The same in SQL."""
    return f"(floor(({expression}) * CAST({scale!r} AS DOUBLE) + 0.5) / CAST({scale!r} AS DOUBLE))"


def rounded(df: DataFrame, *names: str, scale: float = 1e4) -> DataFrame:
    return df.withColumns({n: r(F.col(n), scale) for n in names})
