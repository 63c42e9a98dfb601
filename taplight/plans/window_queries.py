"""Rolling aggregates per key, over flows derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taplight.functions import codes
from taplight.functions import rolling as roll
from taplight.functions.rolling import Rolling
from taplight.functions.windows import share, whole
from taplight.operators import detectors
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import CLASSIFIED_SQL, COMPLETE_SQL, DAY_US, FLOWS_SQL, INCOMPLETE_SQL

SPAN = 3 * DAY_US
_BACK = f"ORDER BY ts_us RANGE BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW"


def _by_source(spark: SparkSession, sf_dir: str, measures: dict[str, roll.Measure]) -> DataFrame:
    return Rolling(("src",), SPAN).over(views.flows(spark, sf_dir), measures)


@query(
    "win_counts",
    f"""WITH flows AS ({FLOWS_SQL})
    SELECT flow_id, count(*) OVER w AS n, count(DISTINCT port) OVER w AS ports, count(DISTINCT dst) OVER w AS hosts,
           count(DISTINCT CASE WHEN port <= 49151 THEN port END) OVER w AS service_ports, count(DISTINCT proto) OVER w AS protos,
           max(ts_us) OVER w - min(ts_us) OVER w AS span_us
    FROM flows WINDOW w AS (PARTITION BY src {_BACK})""",
)
def win_counts(spark, sf_dir):
    service = F.when(F.col("port") <= 49151, F.col("port"))
    measures = {"n": roll.count(), "ports": roll.distinct("port"), "hosts": roll.distinct("dst"), "service_ports": roll.distinct(service), "protos": roll.distinct("proto"), "first": roll.first_time()}
    return _by_source(spark, sf_dir, measures).select("flow_id", "n", "ports", "hosts", "service_ports", "protos", (F.col("ts_us") - F.col("first")).alias("span_us"))


@query(
    "win_ties",
    """WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS id, min(l_suppkey) AS k, min(epoch_us(l_shipdate)) AS t, min(l_partkey) AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT a.id AS flow_id, count(*) AS n, count(DISTINCT b.p) AS parts, min(b.q) AS least, sum(b.q) AS total
    FROM f a JOIN f b ON a.k = b.k AND b.t > a.t - 7 * 86400000000 AND (b.t < a.t OR (b.t = a.t AND b.id <= a.id)) GROUP BY a.id""",
)
def win_ties(spark, sf_dir):
    """Many rows of one key and instant: each sees those that arrived before it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = views.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("flow_id"), "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"), "l_partkey", "l_quantity")
    rows = rows.groupBy("flow_id").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "ts_us", "l_partkey", "l_quantity")))
    measures = {"n": roll.count(), "parts": roll.distinct("l_partkey"), "least": roll.least("l_quantity"), "total": roll.total("l_quantity")}
    return Rolling(("l_suppkey",), 7 * DAY_US).over(rows, measures).select("flow_id", *measures)


@query(
    "win_poisoned_sums",
    f"""WITH flows AS ({FLOWS_SQL})
    SELECT flow_id, CASE WHEN count(orig_bytes) OVER w = count(*) OVER w THEN CAST(sum(orig_bytes) OVER w AS BIGINT) END AS sent,
           CASE WHEN count(orig_bytes) OVER w = count(*) OVER w THEN max(orig_bytes) OVER w END AS largest,
           CAST(sum(resp_bytes) OVER w AS BIGINT) AS received, CAST(sum(orig_pkts) OVER w AS BIGINT) AS packets
    FROM flows WINDOW w AS (PARTITION BY src {_BACK})""",
)
def win_poisoned_sums(spark, sf_dir):
    measures = {"n": roll.count(), "sent": roll.total("orig_bytes"), "known": roll.known("orig_bytes"), "largest": roll.largest("orig_bytes"), "received": roll.total("resp_bytes"), "packets": roll.total("orig_pkts")}
    rows = _by_source(spark, sf_dir, measures)
    return rows.select("flow_id", *(whole(c, "known", "n").alias(c) for c in ("sent", "largest")), "received", "packets")


@query(
    "win_state_shares",
    f"""WITH flows AS ({FLOWS_SQL})
    SELECT flow_id, round(avg(CASE WHEN state IN {CLASSIFIED_SQL} THEN 1 ELSE 0 END) OVER w, 6) AS coverage,
           round(avg(CASE WHEN state IN {INCOMPLETE_SQL} THEN 1 ELSE 0 END) OVER w, 6) AS incomplete,
           round(avg(CASE WHEN resp_bytes >= 100 THEN 1 ELSE 0 END) OVER w, 6) AS established,
           CASE WHEN min(proto) OVER w = max(proto) OVER w THEN min(proto) OVER w END AS only_proto
    FROM flows WINDOW w AS (PARTITION BY src {_BACK})""",
)
def win_state_shares(spark, sf_dir):
    measures = {"n": roll.count(), "coverage": roll.rows_with(codes.classified(F.col("state"))), "incomplete": roll.rows_with(F.col("state").isin(*codes.INCOMPLETE_STATES)), "established": roll.rows_with(F.col("resp_bytes") >= 100), "protos": roll.distinct("proto"), "last_proto": roll.latest("proto")}
    rows = _by_source(spark, sf_dir, measures)
    return rows.select("flow_id", *(F.round(share(c, "n"), 6).alias(c) for c in ("coverage", "incomplete", "established")), F.when(F.col("protos") == 1, F.col("last_proto")).alias("only_proto"))


@query(
    "win_fanout",
    f"""WITH flows AS ({FLOWS_SQL}),
    p AS (SELECT a.flow_id, b.port, count(DISTINCT b.dst) AS n FROM flows a JOIN flows b ON a.src = b.src AND b.ts_us > a.ts_us - {SPAN} AND b.ts_us <= a.ts_us GROUP BY ALL)
    SELECT flow_id, max(n) AS fanout FROM p GROUP BY flow_id""",
)
def win_fanout(spark, sf_dir):
    """How many hosts the widest port of each row's window reaches."""
    return _by_source(spark, sf_dir, {"fanout": roll.widest("port", "dst")}).select("flow_id", "fanout")


@query(
    "win_fanout_port",
    f"""WITH flows AS ({FLOWS_SQL}), late AS (SELECT * FROM flows WHERE k % 10 = 3),
    p AS (SELECT a.flow_id, b.port, count(DISTINCT b.dst) AS n FROM late a JOIN flows b ON a.src = b.src AND b.ts_us > a.ts_us - {SPAN} AND b.ts_us <= a.ts_us GROUP BY ALL)
    SELECT flow_id, max(n) AS fanout, arg_min(port, -n * 100000 + port) AS fanout_port FROM p GROUP BY flow_id""",
)
def win_fanout_port(spark, sf_dir):
    """The widest port itself, for rows that need it as evidence."""
    flows = views.flows(spark, sf_dir)
    return detectors.widest_ports(flows.where("k % 10 = 3"), flows, SPAN)


@query(
    "win_endpoint_fractions",
    f"""WITH flows AS ({FLOWS_SQL}),
    p AS (SELECT a.flow_id, b.dst, b.port, max(CASE WHEN b.state IN {CLASSIFIED_SQL} THEN 1 ELSE 0 END) AS known,
                 max(CASE WHEN b.state IN {COMPLETE_SQL} THEN 1 ELSE 0 END) AS complete, max(CASE WHEN b.resp_bytes >= 100 THEN 1 ELSE 0 END) AS answered
          FROM flows a JOIN flows b ON a.src = b.src AND b.ts_us > a.ts_us - {SPAN} AND b.ts_us <= a.ts_us GROUP BY ALL)
    SELECT flow_id, count(*) AS endpoints, round(avg(known), 6) AS coverage, round(sum(CASE WHEN known = 1 AND complete = 0 THEN 1 ELSE 0 END) / nullif(sum(known), 0), 6) AS incomplete, round(avg(answered), 6) AS answered
    FROM p GROUP BY flow_id""",
)
def win_endpoint_fractions(spark, sf_dir):
    """Shares of the window's distinct (host, port) endpoints."""
    endpoint = F.struct("dst", "port")
    of = lambda c: roll.distinct(F.when(c, endpoint))
    measures = {"endpoints": roll.distinct(endpoint), "known": of(codes.classified(F.col("state"))), "complete": of(F.col("state").isin(*codes.COMPLETE_STATES)), "responded": of(F.col("resp_bytes") >= 100)}
    rows = _by_source(spark, sf_dir, measures)
    return rows.select("flow_id", "endpoints", F.round(share("known", "endpoints"), 6).alias("coverage"), F.round(share(F.col("known") - F.col("complete"), "known"), 6).alias("incomplete"), F.round(share("responded", "endpoints"), 6).alias("answered"))


@query(
    "win_interval_stats",
    f"""WITH flows AS ({FLOWS_SQL}), o AS (SELECT *, lag(ts_us) OVER (PARTITION BY src ORDER BY ts_us) AS prev FROM flows),
    g AS (SELECT a.flow_id, (b.ts_us - b.prev) / 1e6 AS gap FROM o a JOIN o b ON a.src = b.src AND b.ts_us > a.ts_us - {SPAN} AND b.ts_us <= a.ts_us AND b.prev > a.ts_us - {SPAN} WHERE b.ts_us > b.prev)
    SELECT flow_id, count(*) AS n_gaps, CAST(round(sum(gap * 1e6)) AS BIGINT) AS gaps_us, round(stddev_pop(gap) / avg(gap), 4) AS cv FROM g GROUP BY flow_id HAVING count(*) >= 3""",
)
def win_interval_stats(spark, sf_dir):
    """Gaps between a window's rows: both ends inside, zero gaps left out, population deviation."""
    g = F.col("gaps")
    rows = _by_source(spark, sf_dir, {"gaps": roll.gaps()}).where(g["n"] >= 3)
    return rows.select("flow_id", g["n"].alias("n_gaps"), g["us"].alias("gaps_us"), F.round(roll.gap_deviation_us(g) / roll.mean_gap_us(g), 4).alias("cv"))


@query(
    "win_concentration",
    f"""WITH flows AS ({FLOWS_SQL})
    SELECT flow_id, round(CASE WHEN sum(resp_bytes) OVER s > 0 THEN least(sum(resp_bytes) OVER p / sum(resp_bytes) OVER s, 1) ELSE 0 END, 6) AS concentration
    FROM flows WINDOW p AS (PARTITION BY src, dst {_BACK}), s AS (PARTITION BY src {_BACK})""",
)
def win_concentration(spark, sf_dir):
    pair = Rolling(("src", "dst"), SPAN).over(views.flows(spark, sf_dir), {"pair": roll.total("resp_bytes")})
    rows = Rolling(("src",), SPAN).over(pair, {"source": roll.total("resp_bytes")})
    return rows.select("flow_id", F.round(F.when(F.col("source") > 0, F.least(F.col("pair") / F.col("source"), F.lit(1.0))).otherwise(0.0), 6).alias("concentration"))


@query(
    "win_global_features",
    f"""WITH flows AS ({FLOWS_SQL}), o AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY dst ORDER BY ts_us) AS gap, lag(ts_us) OVER (PARTITION BY dst ORDER BY ts_us) AS prev FROM flows),
    j AS (SELECT a.flow_id, a.ts_us AS now, b.ts_us, b.src, b.port, b.resp_bytes, CASE WHEN b.prev >= a.ts_us - 21600000000 THEN b.gap / 1e6 END AS gap
          FROM o a JOIN o b ON a.dst = b.dst AND b.ts_us >= a.ts_us - 21600000000 AND b.ts_us <= a.ts_us),
    c AS (SELECT flow_id, src, count(*) AS n FROM j GROUP BY ALL), e AS (SELECT flow_id, sum(n) AS t, sum(n * log2(n)) AS s FROM c GROUP BY flow_id)
    SELECT j.flow_id, round(count(*) / ((max(now) - min(ts_us)) / 1e6 + 1e-6), 4) AS flow_rate, round(sum(resp_bytes) / ((max(now) - min(ts_us)) / 1e6 + 1e-6), 4) AS byte_rate,
           CAST(coalesce(round(sum(gap * 1e6)), 0) AS BIGINT) AS gaps_us, round(coalesce(stddev_samp(gap), 0), 4) AS gap_stddev, count(DISTINCT port) AS ports, count(DISTINCT src) AS ips,
           round(any_value(log2(t) - s / t), 4) AS src_entropy
    FROM j JOIN e ON j.flow_id = e.flow_id GROUP BY j.flow_id""",
)
def win_global_features(spark, sf_dir):
    """Closed windows: rates, gaps with sample deviation, distinct values and source entropy (per destination here)."""
    measures = {"n": roll.count(), "bytes": roll.total("resp_bytes"), "first": roll.first_time(), "gaps": roll.gaps(), "ports": roll.distinct("port"), "ips": roll.distinct("src"), "logs": roll.count_logs("src")}
    rows = Rolling(("dst",), 6 * 3_600_000_000, closed=True).over(views.flows(spark, sf_dir), measures)
    n, g, span_s = F.col("n"), F.col("gaps"), (F.col("ts_us") - F.col("first")) / 1e6 + 1e-6
    return rows.select(
        "flow_id",
        F.round(n / span_s, 4).alias("flow_rate"),
        F.round(F.col("bytes") / span_s, 4).alias("byte_rate"),
        g["us"].alias("gaps_us"),
        F.round(F.when(n > 2, roll.gap_deviation_us(g, sample=True, n=n - 1) / 1e6).otherwise(0.0), 4).alias("gap_stddev"),
        "ports",
        "ips",
        F.round(F.log2(n.cast("double")) - F.col("logs") / n, 4).alias("src_entropy"),
    )


@query(
    "win_metrics",
    f"""WITH a AS ({views.ALERTS_SQL}), b AS (SELECT ts_us // 60000000 AS minute, threat_class, count(*) AS n, round(max(score), 6) AS top FROM a GROUP BY ALL)
    SELECT *, CAST(sum(n) OVER (PARTITION BY threat_class ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour FROM b""",
)
def win_metrics(spark, sf_dir):
    """Alerts per class and minute and over the last hour of minutes."""
    by_minute = views.alerts(spark, sf_dir).groupBy((F.expr("ts_us div 60000000")).alias("minute"), "threat_class").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("top"))
    return by_minute.withColumn("last_hour", F.sum("n").over(Window.partitionBy("threat_class").orderBy("minute").rangeBetween(-59, 0)))
