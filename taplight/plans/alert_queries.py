"""Folding, correlation, filters and views of alerts derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import codes
from taplight.operators import alerts as ops
from taplight.operators import emit
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import ALERTS_SQL, DAY_US, RANK_SQL, SEVERITY_SQL

HOUR = DAY_US // 24
_A = f"a AS ({ALERTS_SQL})"


def _rated(spark, sf_dir):
    sev = codes.severity(F.col("score"))
    return views.alerts(spark, sf_dir).withColumns({"severity": sev, "rank": codes.severity_rank(sev)})


_RATED = f"{_A}, r AS (SELECT *, {SEVERITY_SQL.format('score')} AS severity, {RANK_SQL.format('score')} AS rank FROM a)"


@query(
    "alert_dedup",
    f"""WITH {_A}, s AS (SELECT *, substr(sha1(concat_ws('|', threat_class, CASE WHEN k % 3 = 0 THEN 'destination' WHEN k % 3 = 1 THEN 'pair' ELSE 'source' END,
        CASE WHEN k % 3 = 0 THEN concat_ws(':', dst, k % 5) WHEN k % 3 = 1 THEN concat_ws('>', src, dst) ELSE src END, concat('d', detector_no))), 1, 32) AS dedup_key FROM a),
    g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {12 * HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY dedup_key ORDER BY ts_us, alert_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY dedup_key ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT dedup_key, min_by(alert_id, ts_us) AS first_id, count(*) AS occurrences, min(ts_us) AS first_seen, max(ts_us) AS last_seen, max(score) AS max_score, max_by(k, ts_us) AS last_evidence FROM n GROUP BY dedup_key, run""",
)
def alert_dedup(spark, sf_dir):
    k = F.col("k")
    scoped = views.alerts(spark, sf_dir).withColumns({"scope": F.when(k % 3 == 0, "destination").when(k % 3 == 1, "pair").otherwise("source"), "port": k % 5, "detector": F.concat(F.lit("d"), "detector_no")})
    return emit.fold_repeats(scoped.withColumn("dedup_key", ops.dedup_key()), ["dedup_key"], 12 * HOUR, evidence="k")


_INCIDENTS = f"""{_RATED}, h AS (SELECT *, CASE WHEN threat_class = 'ddos' THEN dst ELSE src END AS host FROM r),
    g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {4 * HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY host ORDER BY ts_us, alert_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM g)"""


def _incidents(spark, sf_dir):
    hosted = _rated(spark, sf_dir).withColumn("scope", F.lit("flow")).withColumn("host", ops.pivot_host())
    return emit.incidents(hosted, "host", 4 * HOUR, "rank", "stage")


@query(
    "incidents",
    f"""WITH {_INCIDENTS} SELECT host, min_by(alert_id, ts_us) AS first_id, count(*) AS n_alerts, min(ts_us) AS opened_us, max(ts_us) AS updated_us, count(DISTINCT stage) AS n_stages,
    CAST(least(max(rank) + CASE WHEN count(DISTINCT stage) >= 2 THEN 1 ELSE 0 END, 3) AS INT) AS rank, least(count(*), 40) AS last_members FROM n GROUP BY host, run""",
)
def incidents(spark, sf_dir):
    return _incidents(spark, sf_dir).drop("incident_no")


@query(
    "incident_escalation",
    f"""WITH {_INCIDENTS}, i AS (SELECT host, run, count(DISTINCT stage) AS stages, max(rank) AS top FROM n GROUP BY host, run)
    SELECT CAST(stages AS BIGINT) AS n_stages, CAST(least(top + CASE WHEN stages >= 2 THEN 1 ELSE 0 END, 3) AS INT) AS rank, count(*) AS n FROM i GROUP BY ALL""",
)
def incident_escalation(spark, sf_dir):
    return _incidents(spark, sf_dir).groupBy("n_stages", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alert_filter_page",
    f"""WITH {_RATED}, f AS (SELECT * FROM r WHERE (src = '10.0.0.7' OR dst = '192.168.1.2') AND score >= 0.3 AND severity IN ('medium') AND ts_us >= 1704500000000000)
    SELECT alert_id, ts_us, threat_class, score, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts_us DESC, alert_id DESC LIMIT 25 OFFSET 10""",
)
def alert_filter_page(spark, sf_dir):
    chosen = ops.AlertFilter(from_us=1704500000000000, severity="medium", min_score=0.3)
    rows = _rated(spark, sf_dir).where((F.col("src") == "10.0.0.7") | (F.col("dst") == "192.168.1.2"))
    return ops.page(rows, chosen, 25, 10).select("alert_id", "ts_us", "threat_class", "score", "total")


@query(
    "host_rollup",
    f"""WITH {_A}, u AS (SELECT src AS host, ts_us FROM a UNION ALL SELECT dst, ts_us FROM a) SELECT host, min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) AS n FROM u GROUP BY host""",
)
def host_rollup(spark, sf_dir):
    return ops.host_rollup(views.alerts(spark, sf_dir))


@query(
    "host_view",
    f"""WITH {_A}, u AS (SELECT src AS host, dst AS peer, ts_us FROM a UNION ALL SELECT dst, src, ts_us FROM a), p AS (SELECT host, peer, max(ts_us) AS last_seen, count(*) AS alerts FROM u GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY last_seen DESC, peer) AS INT) AS place FROM p QUALIFY place <= 5""",
)
def host_view(spark, sf_dir):
    return ops.recent_peers(views.alerts(spark, sf_dir), 5)


@query(
    "host_counts",
    f"""WITH {_RATED}, u AS (SELECT src AS host, * FROM r UNION ALL SELECT dst, * FROM r)
    SELECT host, severity, threat_class, count(*) AS n, max(ts_us) AS latest FROM u GROUP BY GROUPING SETS ((host, severity), (host, threat_class))""",
)
def host_counts(spark, sf_dir):
    ends = ops.by_role(_rated(spark, sf_dir))
    return ends.groupingSets([["host", "severity"], ["host", "threat_class"]], "host", "severity", "threat_class").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("latest"))


_REGISTRY = "(VALUES ('ddos', 'flows', 40.0, TRUE), ('ddos', 'rate', 0.5, TRUE), ('port_scan', 'flows', 60.0, TRUE), ('c2_beaconing', 'rate', 0.4, FALSE)) v(threat_class, feature, threshold, above)"


@query(
    "evidence_bars",
    f"""WITH {_A}, t AS (SELECT alert_id, threat_class, 'flows' AS feature, CAST(k AS DOUBLE) AS value, NULL AS own FROM a UNION ALL SELECT alert_id, threat_class, 'rate', score, NULL FROM a
        UNION ALL SELECT alert_id, threat_class, 'span', k / 2.0, 20.0 FROM a WHERE k % 4 = 0),
    j AS (SELECT t.alert_id, t.feature, t.value, coalesce(own, v.threshold) AS threshold, coalesce(v.above, TRUE) AS above FROM t LEFT JOIN {_REGISTRY} ON t.threat_class = v.threat_class AND t.feature = v.feature)
    SELECT *, CASE WHEN above THEN value >= threshold ELSE value <= threshold END AS exceeded, greatest(value, threshold * 1.25) AS scale FROM j WHERE threshold IS NOT NULL""",
)
def evidence_bars(spark, sf_dir):
    registry = spark.createDataFrame([("ddos", "flows", 40.0, True), ("ddos", "rate", 0.5, True), ("port_scan", "flows", 60.0, True), ("c2_beaconing", "rate", 0.4, False)], "threat_class string, feature string, threshold double, above boolean")
    base = F.create_map(F.lit("flows"), F.col("k").cast("double"), F.lit("rate"), F.col("score"))
    more = F.create_map(F.lit("span"), F.col("k") / 2, F.lit("span_threshold"), F.lit(20.0))
    rows = views.alerts(spark, sf_dir).withColumn("evidence", F.when(F.col("k") % 4 == 0, F.map_concat(base, more)).otherwise(base))
    return ops.evidence_rows(rows, registry)


@query(
    "evidence_alias",
    f"""WITH {_A} SELECT alert_id, CASE WHEN k % 2 = 0 THEN 'n_flows' ELSE 'flow_count' END AS feature, CAST(k AS DOUBLE) AS value FROM a
    UNION ALL SELECT alert_id, 'flow_count', -1.0 FROM a WHERE k % 2 = 0 UNION ALL SELECT alert_id, 'mean_interval', score FROM a""",
)
def evidence_alias(spark, sf_dir):
    """Keys renamed; an alert that has the new name too keeps the old one beside it."""
    evidence = F.map_concat(F.create_map(F.lit("n_flows"), F.col("k").cast("double"), F.lit("avg_gap"), F.col("score")), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("flow_count"), F.lit(-1.0))).otherwise(F.expr("cast(map() as map<string,double>)")))
    rows = views.alerts(spark, sf_dir).withColumn("evidence", evidence)
    return rows.select("alert_id", F.explode(ops.renamed_evidence({"n_flows": "flow_count", "avg_gap": "mean_interval"})).alias("feature", "value"))


@query(
    "alert_contract",
    f"""WITH {_A}, t AS (SELECT CASE WHEN k % 10 = 0 THEN 'version' END AS a1, CASE WHEN k % 7 = 0 THEN 'protocol' END AS a2, CASE WHEN k % 5 = 0 THEN 'order' END AS a3, CASE WHEN k % 11 = 0 THEN 'evidence' END AS a4 FROM a)
    SELECT reason, count(*) AS n FROM (SELECT unnest([a1, a2, a3, a4]) AS reason FROM t) u WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'accepted', count(*) FROM t WHERE a1 IS NULL AND a2 IS NULL AND a3 IS NULL AND a4 IS NULL""",
)
def alert_contract(spark, sf_dir):
    """Reject reasons and how often each occurs, and the number of good rows."""
    k = F.col("k")
    rows = views.alerts(spark, sf_dir).withColumns(
        {
            "schema_version": F.when(k % 10 == 0, "1.0").otherwise("1.1"),
            "protocol": F.when(k % 7 == 0, "TCP").otherwise("tcp"),
            "scope": F.lit("source"),
            "flow_id": F.lit(None).cast("string"),
            "event_start_us": F.col("ts_us"),
            "event_end_us": F.when(k % 5 == 0, F.col("ts_us") - 1).otherwise(F.col("ts_us") + 1),
            "detected_us": F.col("ts_us") + 2,
            "evidence": F.when(k % 11 == 0, F.expr("cast(map() as map<string,double>)")).otherwise(F.create_map(F.lit("k"), k.cast("double"))),
        }
    )
    reasons = rows.select(ops.reject_reasons().alias("reasons"))
    return reasons.select(F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("accepted")))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "corpus_facts",
    f"""WITH {_RATED} SELECT 'class' AS fact, threat_class AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'host', src, count(*) AS n FROM r GROUP BY src ORDER BY n DESC, src LIMIT 5) t
    UNION ALL SELECT 'time', 'first', min(ts_us) FROM r UNION ALL SELECT 'time', 'last', max(ts_us) FROM r
    UNION ALL SELECT * FROM (SELECT 'score', cast(alert_id AS VARCHAR), CAST(round(score * 1000000) AS BIGINT) FROM r ORDER BY score DESC, alert_id LIMIT 3) u""",
)
def corpus_facts(spark, sf_dir):
    r = _rated(spark, sf_dir)
    tally = lambda fact, c: r.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(fact).alias("fact"), "value", "n")
    when = r.agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last")).unpivot([], ["first", "last"], "value", "n").select(F.lit("time").alias("fact"), "value", "n")
    top = r.orderBy(F.desc("score"), "alert_id").limit(3).select(F.lit("score").alias("fact"), F.col("alert_id").cast("string").alias("value"), F.round(F.col("score") * 1_000_000).cast("long").alias("n"))
    return tally("class", "threat_class").union(tally("severity", "severity")).union(tally("host", "src").orderBy(F.desc("n"), "value").limit(5)).union(when).union(top)


@query(
    "host_fingerprints",
    f"""WITH {_A}, f AS (SELECT *, concat('fp', k % 30) AS fp FROM a WHERE threat_class = 'dns_tunnelling'), u AS (SELECT src AS host, fp, ts_us FROM f UNION ALL SELECT dst, fp, ts_us FROM f), p AS (SELECT host, fp, max(ts_us) AS last_seen, count(*) AS alerts FROM u GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY last_seen DESC, fp) AS INT) AS place FROM p QUALIFY place <= 4""",
)
def host_fingerprints(spark, sf_dir):
    rows = views.alerts(spark, sf_dir).withColumn("fp", F.when(F.col("threat_class") == "dns_tunnelling", F.concat(F.lit("fp"), F.col("k") % 30)))
    return ops.recent(rows, "fp", 4)


@query(
    "incident_notices",
    f"""WITH {_INCIDENTS.replace("FROM r)", "FROM r WHERE ts_us < 1705200000000000)", 1)}, b AS (SELECT host, min(ts_us) AS opened_us, count(*) AS n, least(max(rank) + CASE WHEN count(DISTINCT stage) >= 2 THEN 1 ELSE 0 END, 3) AS rank FROM n GROUP BY host, run),
    h2 AS (SELECT *, CASE WHEN threat_class = 'ddos' THEN dst ELSE src END AS host FROM r), g2 AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {4 * HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h2 WINDOW w AS (PARTITION BY host ORDER BY ts_us, alert_id)),
    n2 AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM g2), c AS (SELECT host, min(ts_us) AS opened_us, count(*) AS n, least(max(rank) + CASE WHEN count(DISTINCT stage) >= 2 THEN 1 ELSE 0 END, 3) AS rank FROM n2 GROUP BY host, run)
    SELECT notice, count(*) AS n FROM (SELECT CASE WHEN b.n IS NULL THEN 'created' WHEN b.n <> c.n OR b.rank <> c.rank THEN 'updated' END AS notice FROM c LEFT JOIN b ON b.host = c.host AND b.opened_us = c.opened_us) t WHERE notice IS NOT NULL GROUP BY 1""",
)
def incident_notices(spark, sf_dir):
    """What is new of incidents once the alerts from a time on are known."""
    hosted = _rated(spark, sf_dir).withColumn("scope", F.lit("flow")).withColumn("host", ops.pivot_host())
    found = lambda rows: emit.incidents(rows, "host", 4 * HOUR, "rank", "stage")
    notices = ops.incident_notices(found(hosted.where("ts_us < 1705200000000000")), found(hosted), ["host", "opened_us"])
    return notices.groupBy("notice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_counts",
    f"""WITH {_RATED} SELECT alert_id, CAST(count(*) OVER (PARTITION BY threat_class, severity ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM r""",
)
def ledger_counts(spark, sf_dir):
    """Alerts of a class and severity in the five minutes up to each, all those of its own instant among them."""
    from taplight.functions import rolling

    return rolling.Rolling(("threat_class", "severity"), 300_000_000, arrival="alert_id", instant=True).over(_rated(spark, sf_dir), {"n": rolling.count()}).select("alert_id", "n")


@query(
    "histogram",
    f"""WITH {_A}, e AS (SELECT threat_class, min(score) AS lo, max(score) AS hi FROM a GROUP BY 1)
    SELECT a.threat_class, CAST(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 24)), 23) END AS INT) AS bin, count(*) AS n FROM a JOIN e ON a.threat_class = e.threat_class GROUP BY ALL""",
)
def histogram(spark, sf_dir):
    return ops.histogram(views.alerts(spark, sf_dir), ["threat_class"], "score", 24)


@query(
    "alert_upsert",
    f"""WITH {_A}, s AS (SELECT alert_id % 500 AS id, alert_id, ts_us, score, k FROM a), o AS (SELECT id, max(ts_us) AS last_seen, max(score) AS score FROM s GROUP BY id)
    SELECT o.id AS alert_id, s.k AS occurrences, o.last_seen, o.score, x.incident_id FROM o JOIN s ON s.id = o.id AND s.ts_us = o.last_seen
    LEFT JOIN (SELECT id, max_by(concat('i', k % 9), ts_us) AS incident_id FROM s WHERE k % 3 = 0 GROUP BY id) x ON x.id = o.id""",
)
def alert_upsert(spark, sf_dir):
    rows = views.alerts(spark, sf_dir).select((F.col("alert_id") % 500).alias("alert_id"), F.col("k").alias("occurrences"), F.col("ts_us").alias("last_seen"), "score", F.when(F.col("k") % 3 == 0, F.concat(F.lit("i"), F.col("k") % 9)).alias("incident_id"))
    half = F.lit(1705200000000000)
    return ops.upsert(rows.where(F.col("last_seen") < half), rows.where(F.col("last_seen") >= half))


@query(
    "topn_recency",
    f"""WITH {_A} SELECT threat_class, alert_id, ts_us FROM a QUALIFY row_number() OVER (PARTITION BY threat_class ORDER BY ts_us DESC, alert_id) <= 3""",
)
def topn_recency(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("threat_class").orderBy(F.desc("ts_us"), "alert_id"))
    return views.alerts(spark, sf_dir).withColumn("place", place).where("place <= 3").select("threat_class", "alert_id", "ts_us")


@query(
    "union_roles",
    f"""WITH {_A}, u AS (SELECT src AS host, 'src' AS role FROM a UNION ALL SELECT dst, 'dst' FROM a) SELECT role, count(DISTINCT host) AS hosts, count(*) AS n FROM u GROUP BY role""",
)
def union_roles(spark, sf_dir):
    return ops.by_role(views.alerts(spark, sf_dir)).groupBy("role").agg(F.count_distinct("host").alias("hosts"), F.count(F.lit(1)).alias("n"))
