"""Small helpers of rules on windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(column: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def seconds(n: float) -> int:
    return int(n * 1_000_000)


def share(part: Column | str, whole: Column | str) -> Column:
    """A share, null of nothing."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.try_divide(of(part).cast("double"), of(whole))


def whole(value: Column | str, known: Column | str, rows: Column | str) -> Column:
    """A window's value, null if any of its rows lacks it."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(of(known) == of(rows), of(value))
