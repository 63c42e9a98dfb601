"""Measures of scores and of runs: classifier metrics, threshold sweeps, percentiles, coverage and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taplight.sources import shared


def _share(n: Column, d: Column) -> Column:
    return F.try_divide(n, F.nullif(d, F.lit(0)))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts, precision, recall and F1 at each threshold; ``scored`` is (score, label 0/1)."""
    wide = scored.agg(*(F.struct(F.lit(t).alias("threshold"), F.count_if((F.col("score") >= t) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("score") >= t) & (F.col("label") == 0)).alias("fp"), F.count_if((F.col("score") < t) & (F.col("label") == 0)).alias("tn"), F.count_if((F.col("score") < t) & (F.col("label") == 1)).alias("fn")).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = wide.select(F.inline(F.array(*(f"t{i}" for i in range(len(thresholds))))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)})


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null where one class is missing.

    Scores are counted first, so what is ranked is the distinct scores.  The running counts are taken within ranges of
    scores, which are sorted in parallel; one row per range gives what lies above it.
    """
    counted = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    part = counted.withColumn("part", F.floor(F.col("score") * 64))
    above = part.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    w = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("part", F.coalesce(F.sum("p").over(w), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"))
    within = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = part.join(above, "part").withColumns({"tp": F.col("p0") + F.sum("pos").over(within), "fp": F.col("n0") + F.sum("neg").over(within)})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return ranked.agg(area.alias("area"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(_share(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision_sum")).select(_share(F.col("area"), F.col("positives") * F.col("negatives")).alias("roc_auc"), F.when(F.col("negatives") > 0, _share(F.col("precision_sum"), F.col("positives"))).alias("pr_auc"), "positives", "negatives")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], parts: int = 64) -> DataFrame:
    """Values at 1-based ``places`` of each key's sorted values; a place is an expression of the count ``n``.

    Equal values are counted first.  A key's distinct values are dealt into ranges of about as many each, by approximate
    quantiles of them, and sorted apart; one row per range tells how many values lie below it.  So no task has all values
    of a key, however they are spread.  The quantiles depend on the order in which shuffled blocks come, so the values are
    dealt once and written: made anew for each reader, ranges would differ between counts and values.
    """
    named = [f"os__{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).alias("os__value"))
    counted = rows.groupBy(*named, "os__value").agg(F.count(F.lit(1)).alias("c"))
    edges = counted.groupBy(*(F.col(n).alias(f"e_{n}") for n in named)).agg(F.percentile_approx("os__value", [i / parts for i in range(1, parts)], 1000).alias("bounds"), F.sum("c").alias("n"))
    same = lambda prefix, on: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in on), F.lit(True))
    dealt = counted.join(edges, same("e_", named)).withColumn("part", F.size(F.filter("bounds", lambda e: e < F.col("os__value"))))
    dealt = shared.written(dealt.select(*named, "os__value", "c", "n", "part"), "dealt")
    below = Window.partitionBy(*(f"o_{n}" for n in named)).orderBy("o_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*(F.col(n).alias(f"o_{n}") for n in (*named, "part"))).agg(F.sum("c").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(below), F.lit(0))).drop("held")
    within = Window.partitionBy(*named, "part").orderBy("os__value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("c").over(within))
    both = ranked.join(offsets, same("o_", [*named, "part"])).withColumn("last", F.col("upto") + F.col("before"))
    at = lambda place: F.max(F.when((place > F.col("last") - F.col("c")) & (place <= F.col("last")), F.col("os__value")))
    found = both.groupBy(*named).agg(F.max("n").alias("total"), *(at(place).alias(name) for name, place in places.items()))
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), F.col("total").alias("n"), *places)


def usable_latency(ms: Column, most_ms: int = 300_000) -> Column:
    """A latency that is not below zero; null where it is so long that the row is of another time."""
    return F.when(ms <= most_ms, F.greatest(ms, F.lit(0)))


def latency_places() -> dict[str, Column]:
    """p50 and p95 as index int(n q) of the sorted values, cut at the last, and the maximum."""
    n = F.col("n")
    return {"p50": F.least(F.floor(n * 0.5), n - 1) + 1, "p95": F.least(F.floor(n * 0.95), n - 1) + 1, "top": n}


def nearest_rank(q: float) -> Column:
    return F.greatest(F.ceil(F.col("n") * q), F.lit(1))


def band_place(q: float) -> Column:
    """Index max(0, int(q n) - 1)."""
    return F.greatest(F.floor(F.col("n") * q) - 1, F.lit(0)) + 1


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which each field is neither null nor empty."""
    present = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(c).cast("string") != "").alias(c) for c in fields))
    return present.unpivot(["total"], fields, "field", "present")


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], label: str, amount: str) -> DataFrame:
    """Consecutive rows of equal label as one, their amounts summed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(F.lag(label).over(w) != F.col(label), F.lit(True)).cast("int")
    runs = df.withColumn("run__new", new).withColumn("run", F.sum("run__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(label).alias(label), F.sum(amount).alias(amount), F.count(F.lit(1)).alias("rows"))
