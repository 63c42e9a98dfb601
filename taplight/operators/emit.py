"""What decides which candidate rows become alerts: cooldown with escalation, folding of repeats, incidents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


#: Gaps in a chunk of a key's time, and ids of alerts that a finding remembers.
CHUNK, RING = 64, 16


def islands(df: DataFrame, keys: list[str], gap_us: int, ts_us: str, arrival: str, name: str, whole: bool = True) -> DataFrame:
    """``df`` with the time at which each row's island begins: rows of a key with no gap above ``gap_us`` between neighbours
    (with ``whole`` off: none of ``gap_us`` or more).

    A key's time is cut into chunks, whose last times and last beginnings are carried on from chunk to chunk in a table of
    a row per chunk; so no task has all rows of a key.  Rows without a time come first and begin nothing but their key.
    """
    by = [*keys, "i__chunk"]
    same = lambda a, b: reduce(and_, (a[c].eqNullSafe(b[f"i__{c}"]) for c in by))
    rows = df.withColumn("i__chunk", F.floor(F.col(ts_us) / (gap_us * CHUNK)).cast("long"))
    order = Window.partitionBy(*by).orderBy(ts_us, arrival)
    named = {c: f"i__{c}" for c in by}

    def carried(table: DataFrame, value: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.col("i__chunk").asc_nulls_first())
        before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return table.withColumns({out: before, f"{out}_any": F.lag(F.lit(True)).over(w)}).select(*(F.col(c).alias(n) for c, n in named.items()), out, f"{out}_any")

    ends = carried(rows.groupBy(*by).agg(F.max(ts_us).alias("i__end")), "i__end", "i__last")
    rows = rows.join(ends, same(rows, ends), "left").drop(*named.values())
    first = F.row_number().over(order) == 1
    gap = F.col(ts_us) - F.when(first, F.col("i__last")).otherwise(F.lag(ts_us).over(order))
    new = (first & F.col("i__last_any").isNull()) | F.coalesce(gap > gap_us if whole else gap >= gap_us, F.lit(False))
    rows = rows.withColumn("i__begin", F.when(new, F.coalesce(F.col(ts_us), F.lit(-(1 << 62))))).drop("i__last", "i__last_any")
    begins = carried(rows.groupBy(*by).agg(F.max("i__begin").alias("i__at")), "i__at", "i__from")
    rows = rows.join(begins, same(rows, begins), "left").drop(*named.values())
    at = F.last("i__begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(at, F.col("i__from"))).drop("i__chunk", "i__begin", "i__from", "i__from_any")


def cooldown(df: DataFrame, keys: list[str], cooldown_us: int, rank: str = "rank", ts_us: str = "ts_us", arrival: str = "flow_id") -> DataFrame:
    """Rows that are emitted: the key's first, those a cooldown after the last emitted, and those of a higher rank.

    Suppressed rows change nothing.  Whatever was emitted before, a row a cooldown after its neighbour is emitted; so a
    key falls apart into islands that are folded by themselves.  Rows of an island go by in order, batch after batch, and
    two numbers are kept: the time and rank of the last emitted row.  A row without a time or rank is compared with
    nothing and emits only as the first of its key.
    """
    parted = islands(df, keys, cooldown_us, ts_us, arrival, "fold__island", whole=False)
    by = [*keys, "fold__island"]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(ts_us, arrival)) == 1
    opened = parted.withColumn("fold__new", first).sortWithinPartitions(*by, ts_us, arrival)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, top = None, None
        for batch in batches:
            kept = []
            for new, t, r in zip(*(batch.column(c).to_pylist() for c in ("fold__new", ts_us, rank)), strict=True):
                emit = new or (t is not None and last is not None and t - last >= cooldown_us) or (r is not None and top is not None and r > top)
                if emit:
                    last, top = t, r
                kept.append(emit)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return opened.mapInArrow(fold, opened.schema).select(*df.columns)


class Finding:
    """One finding of a key: when it began and was last seen, and the last RING ids that were counted."""

    def __init__(self, gap_us: int, begin: int | None = None, last: int | None = None, ids: list | None = None) -> None:
        self.gap_us, self.begin, self.last, self.ids = gap_us, begin, last, ids or []

    def observe(self, at: int, alert_id: object) -> tuple[int, bool]:
        """(when the alert's finding began, whether the alert counts); an id that is remembered changes nothing."""
        if self.last is None or at - self.last > self.gap_us:
            self.begin, self.last, self.ids = at, at, [alert_id]
            return at, True
        if alert_id in self.ids:
            return self.begin, False
        self.last, self.ids = at, [*self.ids, alert_id][-RING:]
        return self.begin, True


def counted(alerts: DataFrame, keys: list[str], gap_us: int, ts_us: str = "ts_us", arrival: str = "alert_id") -> DataFrame:
    """``alerts`` with ``finding_us``, when the finding of each began, and ``counts``: not an alert that was sent again.

    An alert sent again doesn't keep its finding open.  Alerts of a key further apart than the gap are folded by
    themselves, an island to a task.
    """
    by = [*keys, "fold__island"]
    parted = islands(alerts, keys, gap_us, ts_us, arrival, "fold__island")
    first = F.row_number().over(Window.partitionBy(*by).orderBy(ts_us, arrival)) == 1
    opened = parted.withColumn("fold__new", first).sortWithinPartitions(*by, ts_us, arrival)
    own = alerts.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Finding(gap_us)
        for batch in batches:
            out = []
            for new, t, i in zip(*(batch.column(c).to_pylist() for c in ("fold__new", ts_us, arrival)), strict=True):
                if new:
                    state = Finding(gap_us)
                out.append(state.observe(t, i))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_())], [*own, "finding_us", "counts"])

    return opened.where(F.col(ts_us).isNotNull()).mapInArrow(fold, StructType([*alerts.schema.fields, StructField("finding_us", LongType()), StructField("counts", BooleanType())]))


def fold_repeats(alerts: DataFrame, keys: list[str], gap_us: int, ts_us: str = "ts_us", arrival: str = "alert_id", score: str = "score", evidence: str | None = None) -> DataFrame:
    """One row per finding, a key's alerts no more than a gap apart: first id, count, span, best score, last evidence.

    An alert whose id is among the last RING that its finding counted was sent again and changes nothing.
    """
    at = F.struct(ts_us, arrival)
    out = [F.min_by(arrival, at).alias("first_id"), F.count(F.lit(1)).alias("occurrences"), F.min(ts_us).alias("first_seen"), F.max(ts_us).alias("last_seen"), F.max(score).alias("max_score")]
    if evidence:
        out.append(F.max_by(evidence, at).alias("last_evidence"))
    return counted(alerts, keys, gap_us, ts_us, arrival).where("counts").groupBy(*keys, "finding_us").agg(*out).drop("finding_us")


def incidents(alerts: DataFrame, host: str, gap_us: int, rank: str, stage: str, members: int = 40, ts_us: str = "ts_us", arrival: str = "alert_id") -> DataFrame:
    """Runs of a host's alerts no more than a gap apart, with the severity raised by one where two stages meet.

    Member count and severity are of all alerts; ``last_members`` is how many of them a view shows (the latest ones).
    """
    runs = islands(alerts, [host], gap_us, ts_us, arrival, "incident_no")
    grouped = runs.groupBy(host, "incident_no").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.min(ts_us).alias("opened_us"),
        F.max(ts_us).alias("updated_us"),
        F.max(rank).alias("top_rank"),
        F.count_distinct(stage).alias("n_stages"),
        F.min_by(arrival, F.struct(ts_us, arrival)).alias("first_id"),
    )
    raised = F.least(F.col("top_rank") + F.when(F.col("n_stages") >= 2, 1).otherwise(0), F.lit(3))
    return grouped.withColumns({"rank": raised.cast("int"), "last_members": F.least(F.col("n_alerts"), F.lit(members))}).drop("top_rank")
