"""Telemetry views of the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taplight.sources import shared

DAY_US = 86_400_000_000

_FLOWS = """
SELECT event_id AS flow_id, {us} AS ts_us, user_id, k,
       concat('10.0.0.', user_id) AS src, concat('192.168.1.', k % 7) AS dst,
       CAST(1 + (k * 37) % 24 + CASE WHEN k % 10 = 0 THEN 50000 ELSE 0 END AS INT) AS port,
       CASE event_type WHEN 'click' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'tcp' END AS proto,
       CASE k % 23 WHEN 5 THEN 'OTH' WHEN 6 THEN 'odd' WHEN 7 THEN 'RSTR' WHEN 8 THEN 'S2' WHEN 9 THEN 'S3' WHEN 10 THEN 'RSTOS0'
       ELSE CASE event_type WHEN 'signup' THEN 'S0' WHEN 'purchase' THEN 'REJ' WHEN 'error' THEN 'SF' WHEN 'click' THEN 'S1' END END AS state,
       CASE WHEN k % 50 = 49 THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS orig_bytes,
       CAST((k * 13) % 300 AS BIGINT) AS resp_bytes, CAST(1 + k % 10 AS BIGINT) AS orig_pkts, event_type, value
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
"""
#: Connection states that tell whether the exchange was completed, as SQL lists.
COMPLETE_SQL, INCOMPLETE_SQL = "('S1', 'S2', 'S3', 'SF', 'RSTO', 'RSTR')", "('S0', 'REJ', 'RSTOS0', 'RSTRH', 'SH', 'SHR')"
CLASSIFIED_SQL = f"{COMPLETE_SQL[:-1]}, {INCOMPLETE_SQL[1:]}"
FLOWS_SQL = _FLOWS.format(us="epoch_us(ts)", events="events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The events with ``us``, their time in microseconds; a time without a zone is UTC, whatever the session's zone is."""
    rows = read(spark, sf_dir, "events")
    if stream:
        rows = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/event[s].parquet")
    zoned = dict(rows.dtypes)["ts"] == "timestamp"
    return rows.withColumn("us", F.unix_micros("ts") if zoned else F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))


def flows(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Connections: one row per event, all timestamps in UTC microseconds."""
    with shared.view(events(spark, sf_dir, stream)) as name:
        return spark.sql(_FLOWS.format(us="us", events=name))


def address(user: Column) -> Column:
    """The address of a user in log lines whose addresses are checked, one for each user: the view's text ``10.0.0.<user>``
    as far as that is an address, the next ones of 10.0.0.0/8 beyond, and IPv6 where no more are left."""
    byte = lambda bits: F.shiftright(user, bits).bitwiseAND(F.lit(255)).cast("string")
    digits = F.lpad(F.lower(F.hex(user)), 16, "0")
    six = F.concat_ws(":", F.lit("fd00:0:0:0"), *(F.substring(digits, i, 4) for i in (1, 5, 9, 13)))
    return F.when((user >= 0) & (user < 1 << 24), F.concat_ws(".", F.lit("10"), byte(16), byte(8), byte(0))).when(user.isNotNull(), six)


_DNS = """
SELECT page_id, page_id * 10000000 AS ts_us, concat('10.0.1.', page_id % 7) AS src, concat('10.9.9.', page_id % 2) AS resolver,
       lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS query, CASE WHEN page_id % 3 = 0 THEN 'TXT' ELSE 'A' END AS qtype, url
FROM {pages}
"""
DNS_SQL = _DNS.format(pages="pages")


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name queries: one row per page, ten seconds apart."""
    with shared.view(read(spark, sf_dir, "pages")) as pages:
        return spark.sql(_DNS.format(pages=pages))


_ALERTS = """
SELECT event_id AS alert_id, {us} AS ts_us, concat('10.0.0.', user_id % 40) AS src, concat('192.168.1.', k % 4) AS dst, k,
       CASE event_type WHEN 'signup' THEN 'port_scan' WHEN 'purchase' THEN 'ddos' WHEN 'error' THEN 'c2_beaconing' WHEN 'click' THEN 'dns_tunnelling' ELSE 'data_exfiltration' END AS threat_class,
       CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 4 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 3 END AS stage,
       round(least(value / 100.0, 1.0), 6) AS score, CAST(k % 3 AS INT) AS detector_no
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
"""
ALERTS_SQL = _ALERTS.format(us="epoch_us(ts)", events="events")
SEVERITY_SQL = "CASE WHEN {0} >= 0.9 THEN 'critical' WHEN {0} >= 0.75 THEN 'high' WHEN {0} >= 0.6 THEN 'medium' ELSE 'low' END"
RANK_SQL = "CASE WHEN {0} >= 0.9 THEN 3 WHEN {0} >= 0.75 THEN 2 WHEN {0} >= 0.6 THEN 1 ELSE 0 END"


def alerts(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Alerts: one row per event."""
    with shared.view(events(spark, sf_dir, stream)) as name:
        return spark.sql(_ALERTS.format(us="us", events=name))
