"""Enrichment and evaluation joins over views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.operators import enrich
from taplight.plans.catalog import query
from taplight.sources import shared, views
from taplight.sources.views import ALERTS_SQL, DAY_US, FLOWS_SQL

HOUR = DAY_US // 24
_F = f"f AS ({FLOWS_SQL})"
_CONN = "c AS (SELECT concat('C', user_id % 90, '-', k % 10) AS uid, flow_id AS ordinal, ts_us, src, dst, proto, port FROM f WHERE proto <> 'udp')"
_DNS = "d AS (SELECT concat('C', user_id % 90, '-', k % 10) AS uid, flow_id AS ordinal, ts_us, concat('q', k) AS query FROM f WHERE proto = 'udp')"


def _sides(spark, sf_dir):
    f = views.flows(spark, sf_dir).withColumn("uid", F.concat(F.lit("C"), F.col("user_id") % 90, F.lit("-"), F.col("k") % 10)).withColumn("ordinal", F.col("flow_id"))
    return f.where("proto <> 'udp'").select("uid", "ordinal", "ts_us", "src", "dst", "proto", "port"), f.where("proto = 'udp'").select("uid", "ordinal", "ts_us", F.concat(F.lit("q"), "k").alias("query"))


@query(
    "uid_join_first",
    f"""WITH {_F}, {_CONN}, {_DNS}, c1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ordinal) = 1),
    d1 AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, string_agg(query, ',' ORDER BY ordinal) OVER (PARTITION BY uid ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_queries FROM d QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts_us, ordinal) = 1)
    SELECT c1.uid, c1.ordinal, c1.src, c1.port, d1.query, coalesce(d1.n, 0) AS transactions, d1.all_queries FROM c1 LEFT JOIN d1 ON c1.uid = d1.uid""",
)
def uid_join_first(spark, sf_dir):
    conn, dns = _sides(spark, sf_dir)
    joined = enrich.join_first(conn, dns, "dns")
    every = F.array_join(F.transform("dns_transactions", lambda t: t["query"]), ",")
    return joined.select("uid", "ordinal", "src", "port", F.col("dns.query").alias("query"), F.coalesce(F.size("dns_transactions"), F.lit(0)).cast("long").alias("transactions"), every.alias("all_queries"))


@query(
    "uid_join_last",
    f"""WITH {_F}, {_CONN}, {_DNS}, c1 AS (SELECT *, min(ordinal) OVER (PARTITION BY uid) AS first_seen FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ordinal DESC) = 1),
    d1 AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ordinal DESC) = 1) SELECT c1.uid, c1.first_seen, c1.ordinal, c1.port, d1.query FROM c1 LEFT JOIN d1 ON c1.uid = d1.uid""",
)
def uid_join_last(spark, sf_dir):
    conn, dns = _sides(spark, sf_dir)
    return enrich.join_last(conn, dns, "dns").select("uid", "first_seen", "ordinal", "port", F.col("dns.query").alias("query"))


_LINK = f"{_F}, c AS (SELECT concat('C', flow_id // 3) AS uid, flow_id AS record_id, src, dst, proto, CASE WHEN k % 9 = 0 THEN NULL ELSE port END AS port FROM f), r AS (SELECT flow_id AS row_id, concat('C', (flow_id + 1) // 3) AS uid, src, CASE WHEN k % 4 = 0 THEN 'x' ELSE dst END AS dst, CASE WHEN k % 6 = 0 THEN NULL ELSE proto END AS proto, CASE WHEN k % 5 = 0 THEN NULL ELSE port END AS port FROM f)"


def _linkable(spark, sf_dir):
    f, k = views.flows(spark, sf_dir), F.col("k")
    conn = f.select(F.concat(F.lit("C"), F.expr("flow_id div 3")).alias("uid"), F.col("flow_id").alias("record_id"), "src", "dst", "proto", F.when(k % 9 != 0, F.col("port")).alias("port"))
    rows = f.select(F.col("flow_id").alias("row_id"), F.concat(F.lit("C"), F.expr("(flow_id + 1) div 3")).alias("uid"), "src", F.when(k % 4 == 0, "x").otherwise(F.col("dst")).alias("dst"), F.when(k % 6 != 0, F.col("proto")).alias("proto"), F.when(k % 5 != 0, F.col("port")).alias("port"))
    return rows, conn


def _link_sql(port: str) -> str:
    return f"""WITH {_LINK}, m AS (SELECT r.row_id, count(c.record_id) AS cand, count(CASE WHEN r.src = c.src AND r.dst = c.dst AND r.proto = c.proto AND {port} THEN 1 END) AS fit,
        min(CASE WHEN r.src = c.src AND r.dst = c.dst AND r.proto = c.proto AND {port} THEN c.record_id END) AS rid FROM r LEFT JOIN c ON r.uid = c.uid GROUP BY r.row_id)
    SELECT row_id, CASE WHEN fit = 1 THEN 'linked' WHEN fit > 1 THEN 'ambiguous' WHEN cand > 0 THEN 'inconsistent' ELSE 'unlinked' END AS outcome, CASE WHEN fit = 1 THEN rid END AS record_id FROM m"""


@query("tuple_link", _link_sql("(r.port = c.port OR r.port IS NULL OR c.port IS NULL)"))
def tuple_link(spark, sf_dir):
    return enrich.link_to_flows(*_linkable(spark, sf_dir), "row_id", True)


@query("tuple_link_exact", _link_sql("r.port = c.port"))
def tuple_link_exact(spark, sf_dir):
    return enrich.link_to_flows(*_linkable(spark, sf_dir), "row_id", False)


@query(
    "endpoint_backfill",
    f"""WITH {_LINK}, m AS (SELECT r.row_id, any_value(r.proto) AS p, count(c.uid) AS n, min(c.proto) AS q FROM r LEFT JOIN c ON r.uid = c.uid AND r.src = c.src AND r.dst = c.dst GROUP BY r.row_id)
    SELECT row_id, coalesce(p, CASE WHEN n = 1 THEN q END) AS proto FROM m""",
)
def endpoint_backfill(spark, sf_dir):
    return enrich.fill_protocol(*_linkable(spark, sf_dir), "row_id")


_CLASSES = "CASE {0} % 5 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'ddos' WHEN 2 THEN 'c2_beaconing' WHEN 3 THEN 'dns_tunnelling' ELSE 'data_exfiltration' END"
_T0 = 1704067200000000
_INTERVALS = f"SELECT c_custkey AS idx, {_CLASSES.format('c_custkey')} AS threat_class, concat('10.0.0.', (c_custkey * 7) % 40) AS src, {_T0} + (c_custkey % 30) * {DAY_US} AS lo, {_T0} + (c_custkey % 30) * {DAY_US} + (1 + c_nationkey % 12) * {HOUR} AS hi FROM {{customer}}"


def _eval_inputs(spark, sf_dir):
    with shared.view(views.read(spark, sf_dir, "customer")) as customer:
        return views.alerts(spark, sf_dir), spark.sql(_INTERVALS.format(customer=customer))


_MATCHED = f"a AS ({ALERTS_SQL}), i AS ({_INTERVALS.format(customer='customer')}), m AS (SELECT a.alert_id, min(i.idx) AS idx FROM a JOIN i ON a.threat_class = i.threat_class AND a.src = i.src AND a.ts_us >= i.lo - 900000000 AND a.ts_us <= i.hi + 900000000 GROUP BY a.alert_id)"


def _matched(spark, sf_dir):
    alerts, intervals = _eval_inputs(spark, sf_dir)
    met = enrich.interval_join(alerts.withColumn("stop_us", F.col("ts_us")), intervals, ["threat_class", "src"], "ts_us", "stop_us", "lo", "hi", 900_000_000, 6 * HOUR)
    return alerts, intervals, met.groupBy("alert_id").agg(F.min("idx").alias("idx"))


@query("interval_eval", f"WITH {_MATCHED} SELECT a.alert_id, CASE WHEN m.idx IS NULL THEN 'fp' ELSE 'tp' END AS outcome, m.idx FROM a LEFT JOIN m ON a.alert_id = m.alert_id")
def interval_eval(spark, sf_dir):
    alerts, _, met = _matched(spark, sf_dir)
    return alerts.join(met, "alert_id", "left").select("alert_id", F.when(F.col("idx").isNull(), "fp").otherwise("tp").alias("outcome"), "idx")


@query("interval_fn_anti", f"WITH {_MATCHED} SELECT idx, threat_class FROM i WHERE idx NOT IN (SELECT idx FROM m)")
def interval_fn_anti(spark, sf_dir):
    _, intervals, met = _matched(spark, sf_dir)
    return intervals.join(met, "idx", "left_anti").select("idx", "threat_class")


@query(
    "class_pr",
    f"""WITH {_MATCHED}, t AS (SELECT a.threat_class, count(m.idx) AS tp, count(*) - count(m.idx) AS fp FROM a LEFT JOIN m ON a.alert_id = m.alert_id GROUP BY 1),
    n AS (SELECT threat_class, count(*) AS fn FROM i WHERE idx NOT IN (SELECT idx FROM m) GROUP BY 1), g AS (SELECT t.*, coalesce(n.fn, 0) AS fn FROM t LEFT JOIN n ON t.threat_class = n.threat_class)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM g""",
)
def class_pr(spark, sf_dir):
    alerts, intervals, met = _matched(spark, sf_dir)
    hits = alerts.join(met, "alert_id", "left").groupBy("threat_class").agg(F.count("idx").alias("tp"), (F.count(F.lit(1)) - F.count("idx")).alias("fp"))
    missed = intervals.join(met, "idx", "left_anti").groupBy("threat_class").agg(F.count(F.lit(1)).alias("fn"))
    both = hits.join(missed, "threat_class", "left").withColumn("fn", F.coalesce("fn", F.lit(0)).cast("long"))
    share = lambda n, d: F.round(F.try_divide(n, F.nullif(d, F.lit(0))), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


@query(
    "fp_attribution",
    f"""WITH {_MATCHED}, x AS (SELECT a.* FROM a WHERE alert_id NOT IN (SELECT alert_id FROM m)), l AS (SELECT idx, lo, hi, src, {_CLASSES.format('(idx + 1)')} AS mimics FROM i)
    SELECT l.mimics AS threat_class, count(DISTINCT x.alert_id) AS attributed FROM x JOIN l ON x.threat_class = l.mimics AND x.src = l.src AND x.ts_us BETWEEN l.lo - 900000000 AND l.hi + 900000000 GROUP BY 1""",
)
def fp_attribution(spark, sf_dir):
    """Unmatched alerts that fall into traffic that only looks like their class."""
    alerts, intervals, met = _matched(spark, sf_dir)
    unmatched = alerts.join(met, "alert_id", "left_anti").withColumn("stop_us", F.col("ts_us"))
    alike = intervals.select("idx", "src", "lo", "hi", F.expr(_CLASSES.format("(idx + 1)")).alias("threat_class"))
    found = enrich.interval_join(unmatched, alike, ["threat_class", "src"], "ts_us", "stop_us", "lo", "hi", 900_000_000, 6 * HOUR)
    return found.groupBy("threat_class").agg(F.count_distinct("alert_id").alias("attributed"))


@query(
    "entity_range_eval",
    f"""WITH a AS ({ALERTS_SQL}), {_F}, j AS (SELECT a.alert_id, max(CASE WHEN f.state = 'S0' AND a.threat_class = 'port_scan' THEN 1 ELSE 0 END) AS hit, max(CASE WHEN f.state = 'S0' AND a.threat_class <> 'port_scan' THEN 1 ELSE 0 END) AS cross_hit, count(f.flow_id) AS n
        FROM a LEFT JOIN f ON concat('10.0.0.', f.user_id % 40) = a.src AND f.ts_us BETWEEN a.ts_us - 3600000000 AND a.ts_us + 3600000000 GROUP BY a.alert_id)
    SELECT alert_id, CASE WHEN hit = 1 THEN 'tp' WHEN cross_hit = 1 THEN 'cross' WHEN n > 0 THEN 'benign' ELSE 'none' END AS outcome FROM j""",
)
def entity_range_eval(spark, sf_dir):
    alerts = views.alerts(spark, sf_dir).withColumn("stop_us", F.col("ts_us"))
    truth = views.flows(spark, sf_dir).select(F.concat(F.lit("10.0.0."), F.col("user_id") % 40).alias("src"), F.col("ts_us").alias("lo"), F.col("ts_us").alias("hi"), F.col("state").alias("truth_state"))
    met = enrich.interval_join(alerts, truth, ["src"], "ts_us", "stop_us", "lo", "hi", HOUR, 2 * HOUR)
    attack = F.coalesce(F.col("truth_state") == "S0", F.lit(False))
    scan = F.col("threat_class") == "port_scan"
    seen = met.groupBy("alert_id").agg(F.bool_or(attack & scan).alias("hit"), F.bool_or(attack & ~scan).alias("cross_hit"))
    return alerts.select("alert_id").join(seen, "alert_id", "left").select("alert_id", F.when(F.col("hit"), "tp").when(F.col("cross_hit"), "cross").when(F.col("hit").isNotNull(), "benign").otherwise("none").alias("outcome"))


@query(
    "corpus_antijoin",
    """WITH n AS (SELECT o_custkey AS name, o_custkey % 7 + o_orderkey % 2 AS family FROM orders), u AS (SELECT name FROM n GROUP BY name HAVING count(DISTINCT family) = 1),
    s AS (SELECT DISTINCT l_suppkey AS name FROM lineitem) SELECT name, min(family) AS family, count(*) AS n FROM n WHERE name IN (SELECT name FROM u) AND name NOT IN (SELECT name FROM s) GROUP BY name""",
)
def corpus_antijoin(spark, sf_dir):
    """Names of one family only, without those that another list has."""
    names = views.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_custkey") % 7 + F.col("o_orderkey") % 2).alias("family"))
    listed = views.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("name")).distinct()
    kept = names.join(listed, "name", "left_anti").groupBy("name").agg(F.count_distinct("family").alias("families"), F.min("family").alias("family"), F.count(F.lit(1)).alias("n"))
    return kept.where("families = 1").drop("families")


@query(
    "longest_suffix",
    """WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), s AS (SELECT unnest(['com', 'example.com', 'net', 'org', 'm.example.org']) AS suffix)
    SELECT h.host, max_by(s.suffix, length(s.suffix)) AS suffix FROM h LEFT JOIN s ON h.host = s.suffix OR h.host LIKE '%.' || s.suffix GROUP BY h.host""",
)
def longest_suffix(spark, sf_dir):
    hosts = views.dns(spark, sf_dir).select(F.col("query").alias("host")).distinct()
    return enrich.longest_suffix(hosts, spark.createDataFrame([("com",), ("example.com",), ("net",), ("org",), ("m.example.org",)], "suffix string"))


@query(
    "merge_live",
    f"""WITH a AS ({ALERTS_SQL}), l AS (SELECT alert_id, ts_us, 'live' AS origin FROM a WHERE alert_id % 3 = 0), s AS (SELECT alert_id, ts_us, 'stored' AS origin FROM a WHERE alert_id % 2 = 0)
    SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM s WHERE alert_id NOT IN (SELECT alert_id FROM l)) u ORDER BY ts_us DESC, alert_id LIMIT 500""",
)
def merge_live(spark, sf_dir):
    a = views.alerts(spark, sf_dir).select("alert_id", "ts_us")
    return enrich.merge_live(a.where("alert_id % 3 = 0").withColumn("origin", F.lit("live")), a.where("alert_id % 2 = 0").withColumn("origin", F.lit("stored")), "alert_id", "ts_us", 500)


@query("same_rows", "SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 3) x) AS only_left, CAST(0 AS BIGINT) AS only_right")
def same_rows(spark, sf_dir):
    orders = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return enrich.same_rows(orders, orders.where("o_orderkey % 10 <> 3"))
