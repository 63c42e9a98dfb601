"""Parts of lists and tables: strides, ticks, what a view shows, and capped groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stride(items: Column, most: int = 120) -> Column:
    """Every n-th item, n as small as leaves about ``most``, and no more than these."""
    step = F.greatest(F.expr("1"), F.floor(F.size(items) / most).cast("int"))
    return F.slice(F.filter(items, lambda _, i: i % step == 0), 1, most)


def ticks(n: Column, most: int = 6) -> Column:
    """Evenly spaced places from 0, and the last one; none of nothing."""
    step = F.greatest(F.lit(1), F.ceil(n / most).cast("int"))
    return F.when(n > 0, F.array_distinct(F.concat(F.sequence(F.lit(0), n - 1, step), F.array(n - 1)))).otherwise(F.array().cast("array<int>"))


def visible_rows(scrolled: Column, height: Column, total: Column, row: int, beyond: int) -> Column:
    """(first, last): the rows that a view of some height shows, with some beyond both its edges."""
    first = F.greatest(F.lit(0), F.floor(F.greatest(scrolled, F.lit(0)) / row).cast("long") - beyond)
    shown = F.when(height > 0, F.ceil(height / row).cast("long") + 2 * beyond).otherwise(F.lit(2 * beyond).cast("long"))
    some = total > 0
    return F.struct(F.when(some, first).otherwise(0).alias("first"), F.when(some, F.least(total, first + shown)).otherwise(0).alias("last"))


def capped(rows: DataFrame, group: str, item: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group, chosen by a hash of the item, so that the choice is the same each time.

    A large group is first cut in parts: only rows that are among the ``cap`` first of their part meet in one task.
    """
    draw = F.xxhash64(item, F.lit(seed))
    drawn = rows.withColumns({"cap__draw": draw, "cap__part": F.pmod(draw, F.lit(64))})
    place = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("cap__draw", item))
    some = drawn.withColumn("cap__place", place([group, "cap__part"])).where(F.col("cap__place") <= cap)
    return some.withColumn("cap__place", place([group])).where(F.col("cap__place") <= cap).drop("cap__draw", "cap__part", "cap__place")
