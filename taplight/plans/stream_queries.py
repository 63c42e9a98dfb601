"""The streaming operators over the events table, read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taplight.plans.catalog import query
from taplight.plans.detector_queries import fold_sql
from taplight.sources import shared, views
from taplight.sources.views import ALERTS_SQL, DAY_US, RANK_SQL
from taplight.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir, stream=True).withColumn("ts", F.timestamp_micros("us")).drop("us")


@query(
    "stream_cooldown",
    fold_sql("SELECT alert_id, ts_us, src, score FROM a", "src", DAY_US // 4, "alert_id", "alert_id, src, CAST(rank AS INT) AS rank", f"a AS ({ALERTS_SQL})"),
)
def stream_cooldown(spark, sf_dir):
    """The fold with keyed state; the batch query cooldown_fold gives the same rows."""
    rated = views.alerts(spark, sf_dir, stream=True).selectExpr("alert_id", "src", "ts_us", f"CAST({RANK_SQL.format('score')} AS INT) AS rank")
    emitted = live.cooldown(rated, ["src"], DAY_US // 4, "alert_id long, src string, ts_us long, rank int", arrival="alert_id")
    return live.drain(emitted, shared.folder(spark, "stream")).select("alert_id", "src", "rank")


@query("stream_rates", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_rates(spark, sf_dir):
    """Counts per type and day of all events, those of the last day too."""
    return live.drain_complete(live.rates(_events(spark, sf_dir), ["event_type"], "ts", "1 day"), shared.folder(spark, "stream"))


@query("stream_repeats", "SELECT event_id AS alert_id, event_type FROM events")
def stream_repeats(spark, sf_dir):
    """Every event comes twice; the second is left out."""
    once = _events(spark, sf_dir).select(F.col("event_id").alias("alert_id"), "event_type", "ts")
    again = _events(spark, sf_dir).select(F.col("event_id").alias("alert_id"), "event_type", "ts")
    return live.drain(live.first_of_repeats(once.union(again), "alert_id", "ts", "3650 days"), shared.folder(spark, "stream")).select("alert_id", "event_type")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, value, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 6 * 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, count(*) AS occurrences, max(value) AS max_score, min(us) AS first_us, max(us) AS last_us FROM r GROUP BY user_id, run""",
)
def stream_sessions(spark, sf_dir):
    """Runs of a user's events less than six hours apart."""
    rows = _events(spark, sf_dir).withColumn("score", F.col("value"))
    found = live.drain_complete(live.sessions(rows, "user_id", "ts", "6 hours"), shared.folder(spark, "stream"))
    return found.select("user_id", "occurrences", "max_score", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))
