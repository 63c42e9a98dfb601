"""Rules, findings and late rows on a stream whose rows come out of order, in several micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.operators import emit
from taplight.plans import detector_queries as det
from taplight.plans.catalog import ORACLES, query
from taplight.sources import shared, views
from taplight.sources.views import ALERTS_SQL, DAY_US, FLOWS_SQL
from taplight.streaming import live, ordered

HOUR = DAY_US // 24
BATCHES, DELAY_US = 4, 6 * HOUR
#: The time of the last heartbeat, that of the year 2200.
_END_US = 7_258_118_400_000_000
#: The batch in which a row comes: time in four parts, a third of a part shuffled into the next one, and some far too late.
_BATCH = "CAST(least(floor((ts_us - 1704067200000000) / 648000000000.0) + CASE WHEN {late} THEN 2 ELSE 0 END, 3) AS INT)"
_LATE = "k % 37 = 5"


def _drained(rows: DataFrame, keys: list[str], arrival: str, batch: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``fold`` gives for ``rows`` as a stream of BATCHES parts that come one after another, and a last one with a
    heartbeat for every key.

    A part is of as many files as its rows need, written by as many tasks, and is one micro-batch: the stream stops at
    what is there and goes on from its checkpoint when the next part has come.
    """
    spark = rows.sparkSession
    staged, out = shared.folder(spark, "staged"), shared.folder(spark, "stream")
    placed = rows.withColumn("batch", F.expr(batch)).withColumn("shuffled", F.xxhash64(arrival))
    beat = rows.select(*keys).distinct().withColumn("ts_us", F.lit(_END_US))
    beats = beat.select(*((F.col(c) if c in (*keys, "ts_us") else F.lit(None).cast(t).alias(c)) for c, t in rows.dtypes))
    parts = [placed.where(F.col("batch") == b).drop("batch").repartition("shuffled").sortWithinPartitions("shuffled").drop("shuffled") for b in range(BATCHES)]
    for part in (*parts, beats):
        part.write.mode("append").parquet(staged)
        # Only after the last part a batch without rows follows, in which keys that have become idle go.
        with live.rocks(spark), shared.settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": str(part is beats).lower()}):
            found = live.drain(fold(spark.readStream.schema(rows.schema).parquet(staged)), out)
    return found


def _rule(spark, sf_dir, make, keys, added):
    """A rule on the flows out of order, none of them later than the delay: by the batch of the time, in any order."""
    columns = ["flow_id", "ts_us", "src", "dst", "port", "state", "resp_bytes", "orig_pkts"]
    rows = views.flows(spark, sf_dir).select(*columns)
    fold = lambda stream: ordered.in_order(stream, keys, make, added, DELAY_US)
    return _drained(rows, keys, "flow_id", _BATCH.format(late="false"), fold).where("not late")


@query("stream_flood", ORACLES["det_flood"])
def stream_flood(spark, sf_dir):
    """The flood rule with its window in keyed state."""
    found = _rule(spark, sf_dir, partial(ordered.FloodFold, det.FLOOD), ["dst"], "score double, severity string, sources int, flows int")
    return found.select("flow_id", "ts_us", "score", "severity", F.col("sources").cast("long").alias("sources"), F.col("flows").cast("long").alias("flows"))


@query("stream_scan", ORACLES["det_scan"])
def stream_scan(spark, sf_dir):
    """The scan rule with its window in keyed state."""
    found = _rule(spark, sf_dir, partial(ordered.ScanFold, det.SCAN), ["src"], "score double, severity string, ports int, fanout int")
    return found.select("flow_id", "ts_us", "score", "severity", F.col("ports").cast("long").alias("ports"), F.col("fanout").cast("long").alias("fanout"))


#: Alerts of which a third come again under an id that the key had up to 20 alerts before.
_SENT = """SELECT src, ts_us, k, score, CASE WHEN k % 3 = 0 THEN greatest(n - 1 - k % 20, 0) ELSE n END AS alert_id, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts_us, alert_id) AS n FROM {alerts}) r"""
_FINDINGS_SQL = """f AS (SELECT src, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS last, CAST([] AS BIGINT[]) AS ids, FALSE AS counts FROM (SELECT DISTINCT src FROM s)
    UNION ALL SELECT s.src, s.n, CASE WHEN new THEN s.ts_us ELSE x.began END, CASE WHEN new OR NOT again THEN s.ts_us ELSE x.last END, CASE WHEN new THEN [s.alert_id] WHEN again THEN x.ids ELSE list_concat(x.ids, [s.alert_id])[-16:] END, new OR NOT again
    FROM (SELECT f.src, f.n, f.began, f.last, f.ids, coalesce(t.ts_us - f.last > {gap}, TRUE) AS new, list_contains(f.ids, t.alert_id) AS again FROM f JOIN s t ON t.src = f.src AND t.n = f.n + 1) x JOIN s ON s.src = x.src AND s.n = x.n + 1)"""
_GAP_US = 12 * HOUR
_RESENDS = f"WITH RECURSIVE a AS ({ALERTS_SQL}), s AS ({_SENT.format(alerts='a')}), {_FINDINGS_SQL.format(gap=_GAP_US)}"


def _sent(spark, sf_dir):
    with shared.view(views.alerts(spark, sf_dir)) as alerts:
        return spark.sql(_SENT.format(alerts=alerts))


@query("alert_resends", f"{_RESENDS} SELECT s.src, began AS first_seen, count(*) AS occurrences, max(s.ts_us) AS last_seen, max(score) AS max_score FROM f JOIN s USING (src, n) WHERE counts GROUP BY s.src, began")
def alert_resends(spark, sf_dir):
    """Findings of alerts some of which were sent again, under an id that is still remembered or no more."""
    return emit.fold_repeats(_sent(spark, sf_dir), ["src"], _GAP_US).select("src", "first_seen", "occurrences", "last_seen", "max_score")


@query("stream_findings", f"{_RESENDS} SELECT src, f.n, began AS finding_us, counts FROM f WHERE f.n > 0")
def stream_findings(spark, sf_dir):
    """The same on a stream out of order, with the last ids of a finding in keyed state."""
    rows = _sent(spark, sf_dir).select("src", "ts_us", "alert_id", "n")
    fold = lambda stream: ordered.in_order(stream, ["src"], partial(ordered.Findings, _GAP_US), "finding_us long, counts boolean", DELAY_US, arrival="n")
    found = _drained(rows, ["src"], "n", _BATCH.format(late="false"), fold)
    return found.where("not late").select("src", "n", "finding_us", "counts")


@query(
    "stream_late",
    f"""WITH fl AS ({FLOWS_SQL}), b AS (SELECT *, {_BATCH.format(late=_LATE)} AS batch FROM fl), t AS (SELECT *, max(ts_us) OVER (PARTITION BY src ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b),
    l AS (SELECT *, coalesce(ts_us <= top - {DELAY_US}, FALSE) AS late FROM t), o AS (SELECT flow_id, row_number() OVER (PARTITION BY src ORDER BY ts_us, flow_id) AS place FROM l WHERE NOT late)
    SELECT flow_id, src, late, place FROM l LEFT JOIN o USING (flow_id)""",
)
def stream_late(spark, sf_dir):
    """Rows out of order: each one's place in the order of its key, and those that came too late for one."""
    rows = views.flows(spark, sf_dir).select("flow_id", "ts_us", "src", "k")
    fold = lambda stream: ordered.in_order(stream, ["src"], ordered.Places, "place long", DELAY_US)
    return _drained(rows, ["src"], "flow_id", _BATCH.format(late=_LATE), fold).select("flow_id", "src", "late", "place")
