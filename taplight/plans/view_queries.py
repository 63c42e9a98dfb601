"""What is shown of alerts: projections, reports, lists, groups, samples, times and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import samples, text, times
from taplight.operators import alerts as ops
from taplight.operators import emit
from taplight.plans.alert_queries import _INCIDENTS, _RATED, HOUR, _incidents, _rated
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import ALERTS_SQL, FLOWS_SQL

_A = f"a AS ({ALERTS_SQL})"


@query(
    "alert_projection",
    f"""WITH {_A}, g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > {12 * HOUR} OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY src, threat_class ORDER BY ts_us, alert_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY src, threat_class ORDER BY ts_us, alert_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT alert_id AS received_id, first_value(alert_id) OVER r AS alert_id, max(score) OVER r AS score, count(*) OVER r AS occurrences, min(ts_us) OVER r AS first_seen, max(ts_us) OVER r AS last_seen, round((k % 1000) * 7 / 1000.0, 3) AS detector_latency_ms, round(250 / 1000.0, 3) AS transport_latency_ms, round(((k % 1000) * 7 + 250) / 1000.0, 3) AS pipeline_latency_ms
    FROM n WINDOW r AS (PARTITION BY src, threat_class, run ORDER BY ts_us, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def alert_projection(spark, sf_dir):
    rows = views.alerts(spark, sf_dir).withColumns({"dedup_key": F.concat_ws("|", "src", "threat_class"), "event_end_us": F.col("ts_us"), "detected_us": F.col("ts_us") + (F.col("k") % 1000) * 7, "ingested_us": F.col("ts_us") + (F.col("k") % 1000) * 7 + 250})
    shown = ops.project(rows, emit.fold_repeats(rows, ["dedup_key"], 12 * HOUR))
    return shown.select("received_id", "alert_id", "score", "occurrences", "first_seen", "last_seen", "detector_latency_ms", "transport_latency_ms", "pipeline_latency_ms")


def _contract_rows(spark, sf_dir):
    k = F.col("k")
    return views.alerts(spark, sf_dir).select("alert_id", F.when(k % 31 == 0, "1.0").otherwise("1.1").alias("schema_version"), F.when(k % 37 == 0, "TCP").otherwise("tcp").alias("protocol"), "score", F.col("ts_us").alias("event_start_us"), F.when(k % 41 == 0, F.col("ts_us") - 1).otherwise(F.col("ts_us")).alias("event_end_us"), F.col("ts_us").alias("detected_us"), F.lit("source").alias("scope"), F.lit(None).cast("string").alias("flow_id"), F.create_map(F.lit("x"), F.lit(1.0)).alias("evidence"))


_BAD = "CASE WHEN k % 31 = 0 THEN 'version' END, CASE WHEN k % 37 = 0 THEN 'protocol' END, CASE WHEN k % 41 = 0 THEN 'order' END"


@query("bulk_counts", f"WITH {_A} SELECT count(CASE WHEN k % 31 <> 0 AND k % 37 <> 0 AND k % 41 <> 0 THEN 1 END) AS accepted, count(CASE WHEN k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 THEN 1 END) AS rejected FROM a")
def bulk_counts(spark, sf_dir):
    return ops.bulk_report(_contract_rows(spark, sf_dir), "alert_id")[0]


@query("bulk_errors", f"WITH {_A} SELECT alert_id, concat_ws(',', {_BAD}) AS errors FROM a WHERE k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 ORDER BY alert_id LIMIT 25")
def bulk_errors(spark, sf_dir):
    """The first rejected alerts; how many are told is the report's feature."""
    return ops.bulk_report(_contract_rows(spark, sf_dir), "alert_id")[1].select("alert_id", F.array_join("errors", ",").alias("errors"))


@query(
    "incident_list",
    f"""WITH {_INCIDENTS}, i AS (SELECT host, max(ts_us) AS updated_us, count(*) AS n_alerts, CAST(least(max(rank) + CASE WHEN count(DISTINCT stage) >= 2 THEN 1 ELSE 0 END, 3) AS INT) AS rank FROM n GROUP BY host, run),
    l AS (SELECT * FROM i ORDER BY updated_us DESC, host LIMIT 120), f AS (SELECT * FROM l WHERE rank = 2)
    SELECT host, updated_us, n_alerts, rank, (SELECT count(*) FROM f) AS total FROM f ORDER BY updated_us DESC, host LIMIT 30""",
)
def incident_list(spark, sf_dir):
    """One page of incidents of a rank; the page is the feature."""
    return ops.incident_list(_incidents(spark, sf_dir), 30, rank=2).select("host", "updated_us", "n_alerts", "rank", "total")


@query(
    "incident_members",
    f"""WITH {_INCIDENTS}, l AS (SELECT *, row_number() OVER (PARTITION BY host, run ORDER BY ts_us DESC, alert_id DESC) AS back FROM n)
    SELECT host, alert_id, stage, row_number() OVER (PARTITION BY host, run ORDER BY stage, ts_us, alert_id) AS place FROM l WHERE back <= 5""",
)
def incident_members(spark, sf_dir):
    from pyspark.sql import Window

    hosted = _rated(spark, sf_dir).withColumn("scope", F.lit("flow")).withColumn("host", ops.pivot_host())
    w = Window.partitionBy("host").orderBy("ts_us", "alert_id")
    opened = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) > 4 * HOUR, F.lit(True)).cast("int")
    runs = hosted.withColumn("opened", opened).withColumn("run", F.sum("opened").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ops.incident_members(runs, ["host", "run"], "stage", 5).select("host", "alert_id", "stage", F.col("place").cast("long").alias("place"))


@query(
    "stream_groups",
    f"""WITH {_RATED}, s AS (SELECT *, CASE WHEN k % 4 = 0 THEN NULL ELSE concat('i', k % 200) END AS incident, coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE concat('i', k % 200) END, concat('alert ', alert_id)) AS key FROM r),
    c AS (SELECT key, threat_class, min({{'t': ts_us, 'a': alert_id}}) AS seen FROM s GROUP BY ALL), l AS (SELECT key, string_agg(threat_class, ',' ORDER BY seen) AS codes FROM c GROUP BY key)
    SELECT s.key, count(*) AS shown, max(rank) AS rank, max(ts_us) AS latest, any_value(l.codes) AS codes, CASE WHEN count(*) > 1 THEN 'group' ELSE 'alert' END AS kind, CASE WHEN min(src) = max(src) THEN min(src) ELSE s.key END AS label FROM s JOIN l ON s.key = l.key GROUP BY s.key""",
)
def stream_groups(spark, sf_dir):
    rows = _rated(spark, sf_dir).withColumns({"incident_id": F.when(F.col("k") % 4 != 0, F.concat(F.lit("i"), F.col("k") % 200)), "code": F.col("threat_class")})
    return ops.stream_groups(rows).withColumn("codes", F.array_join("codes", ","))


@query(
    "detector_status",
    f"""WITH {_A} SELECT concat('d', k % 17) AS detector, count(*) AS alerts, max(ts_us) AS last_seen, round(avg(k % 100), 3) AS mean_latency_ms, string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS classes, CASE WHEN (SELECT max(ts_us) FROM a) - max(ts_us) <= 120000000 THEN 'online' ELSE 'degraded' END AS state FROM a GROUP BY 1""",
)
def detector_status(spark, sf_dir):
    rows = views.alerts(spark, sf_dir).withColumns({"detector": F.concat(F.lit("d"), F.col("k") % 17), "latency_ms": F.col("k") % 100})
    now = rows.agg(F.max("ts_us")).first()[0]
    return ops.detector_status(rows, now).withColumn("classes", F.array_join("classes", ","))


@query("length_histogram", "SELECT lang, (length(text) // 10) * 10 AS bin_start, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def length_histogram(spark, sf_dir):
    return ops.length_histogram(views.read(spark, sf_dir, "documents").withColumn("size", F.char_length("text")), ["lang"], "size")


@query("peak_rate", f"WITH {_A}, s AS (SELECT threat_class, ts_us // 1000000 AS second, count(*) AS n FROM a GROUP BY ALL) SELECT threat_class, max(n) AS peak FROM s GROUP BY 1")
def peak_rate(spark, sf_dir):
    return ops.peak_rate(views.alerts(spark, sf_dir), ["threat_class"])


@query(
    "fingerprint_feed",
    f"""WITH f AS ({FLOWS_SQL}), m AS (SELECT k % 8 AS m, lower(md5(cast(k % 40 AS VARCHAR))) AS h, k % 40 AS v FROM f)
    SELECT DISTINCT CASE m WHEN 0 THEN 'ja3' WHEN 1 THEN 'ja3s' WHEN 2 THEN 'ja4' WHEN 3 THEN 'ja3' WHEN 6 THEN 'ja5' WHEN 7 THEN 'ja4' END AS kind, CASE m WHEN 0 THEN h WHEN 1 THEN h WHEN 2 THEN concat('t13d_', v) WHEN 3 THEN concat('zz', v) WHEN 6 THEN h WHEN 7 THEN '' END AS value, CASE m WHEN 3 THEN 'digest' WHEN 6 THEN 'kind' WHEN 7 THEN 'empty' END AS reason FROM m WHERE m NOT IN (4, 5)""",
)
def fingerprint_feed(spark, sf_dir):
    m, digest, v = F.col("k") % 8, F.md5((F.col("k") % 40).cast("string").cast("binary")), (F.col("k") % 40).cast("string")
    line = F.when(m == 0, F.concat(F.lit("  "), F.upper(digest))).when(m == 1, F.concat(F.lit("JA3S: "), digest)).when(m == 2, F.concat(F.lit("ja4:T13D_"), v)).when(m == 3, F.concat(F.lit("zz"), v)).when(m == 4, "# comment").when(m == 5, "  ").when(m == 6, F.concat(F.lit("ja5:"), digest)).otherwise("ja4: ")
    return ops.fingerprint_feed(views.flows(spark, sf_dir).select(line.alias("value")))


@query(
    "alert_capture",
    f"""WITH {_A} SELECT CASE WHEN k % 9 = 3 THEN '' ELSE concat('t', k % 100) END AS detected_at, count(*) AS n FROM a WHERE k % 9 > 2 GROUP BY 1""",
)
def alert_capture(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 9 == 0, "// note").when(k % 9 == 1, '{"broken"').when(k % 9 == 2, "[1]").when(k % 9 == 3, F.concat(F.lit('{"alert_id": '), "alert_id", F.lit("}"))).otherwise(F.concat(F.lit('{"detected_at": "t'), k % 100, F.lit('"}')))
    return ops.alert_capture(views.alerts(spark, sf_dir).select(line.alias("value"))).groupBy("detected_at").agg(F.count(F.lit(1)).alias("n"))


_HEAT = "CASE WHEN ch IN ('.', '-') THEN 0.0 WHEN ch >= '0' AND ch <= '9' THEN 0.85 WHEN ch IN ('a', 'e', 'i', 'o', 'u') THEN 0.15 ELSE least(0.35 + 0.2 * (i - coalesce(last, 0)), 1.0) END"


@query(
    "character_heat",
    f"""WITH u AS (SELECT page_id, lower(url) AS s FROM pages), c AS (SELECT page_id, i, s[i] AS ch FROM (SELECT page_id, s, unnest(range(1, length(s) + 1)) AS i FROM u) t),
    b AS (SELECT *, max(CASE WHEN ch IN ('.', '-', 'a', 'e', 'i', 'o', 'u') OR (ch >= '0' AND ch <= '9') THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM c)
    SELECT page_id, round(sum({_HEAT}), 6) AS heat, max(i)::INT AS n FROM b GROUP BY page_id""",
)
def character_heat(spark, sf_dir):
    rows = views.read(spark, sf_dir, "pages").select("page_id", text.character_heat(F.col("url")).alias("heat"))
    return rows.select("page_id", F.round(F.aggregate("heat", F.lit(0.0), lambda a, x: a + x), 6).alias("heat"), F.size("heat").alias("n"))


@query(
    "shown_numbers",
    f"""WITH {_A} SELECT alert_id, CASE k % 5 WHEN 0 THEN 'not reported' WHEN 1 THEN cast(k AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.4f', (k % 900) / 1000.0 + 0.1), '0+$', ''), '\\.$', '') END AS shown FROM a WHERE k % 900 <> 0""",
)
def shown_numbers(spark, sf_dir):
    k = F.col("k")
    value = F.when(k % 5 == 1, k.cast("double")).when(k % 5 > 1, F.round((k % 900) / 1000.0 + 0.1, 4))
    return views.alerts(spark, sf_dir).where(k % 900 != 0).select("alert_id", text.shown_number(value).alias("shown"))


@query(
    "unsupported_numbers",
    f"""WITH {_A} SELECT alert_id, concat_ws(',', CASE WHEN k % 3 = 0 AND k + 11 <> alert_id THEN cast(k + 11 AS VARCHAR) END, CASE WHEN alert_id % 2 = 0 THEN '3.5' END) AS numbers FROM a""",
)
def unsupported_numbers(spark, sf_dir):
    said = F.concat(F.lit("saw "), "alert_id", F.lit(" and 7, "), F.when(F.col("k") % 3 == 0, (F.col("k") + 11).cast("string")).otherwise(F.lit("some")), F.when(F.col("alert_id") % 2 == 0, " 3.5 times").otherwise(" once"))
    facts = F.concat(F.lit("alert "), "alert_id")
    return views.alerts(spark, sf_dir).select("alert_id", F.array_join(text.unsupported_numbers(said, facts), ",").alias("numbers"))


@query(
    "iso_times",
    f"""WITH {_A}, t AS (SELECT alert_id, CASE WHEN k % 2 = 0 THEN ts_us // 1000000 * 1000000 ELSE ts_us // 1000000 * 1000000 + k % 999983 + 1 END AS us FROM a)
    SELECT alert_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || lpad(cast(us % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS iso, us AS back, CAST(NULL AS BIGINT) AS naive FROM t""",
)
def iso_times(spark, sf_dir):
    whole = F.expr("ts_us div 1000000 * 1000000")
    us = F.when(F.col("k") % 2 == 0, whole).otherwise(whole + F.col("k") % 999983 + 1)
    made = views.alerts(spark, sf_dir).select("alert_id", us.alias("us")).withColumn("iso", times.iso(F.col("us")))
    return made.select("alert_id", "iso", times.epoch_us(F.col("iso")).alias("back"), times.epoch_us(F.regexp_replace("iso", "Z$", "")).alias("naive"))


@query(
    "decimal_times",
    f"""WITH {_A}, t AS (SELECT alert_id, k, ts_us // 1000000 AS s, k % 6 AS m FROM a), n AS (SELECT *, CASE m WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.000123' WHEN 3 THEN '.123456789' WHEN 4 THEN '.1234567891' ELSE '.25000000000' END AS f FROM t)
    SELECT alert_id, CASE WHEN m <> 4 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE m WHEN 0 THEN '' WHEN 1 THEN '.500' WHEN 2 THEN '.000123' WHEN 3 THEN '.123456789' ELSE '.250' END || 'Z' END AS start,
    CASE WHEN m IN (0, 1, 5) AND k % 4 <> 0 THEN strftime(make_timestamp((s + CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END) * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE m WHEN 0 THEN '.500' WHEN 1 THEN '' ELSE '.750' END || 'Z'
         WHEN m = 2 AND k % 4 <> 0 THEN strftime(make_timestamp((s + 1) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.500123Z' WHEN m = 3 AND k % 4 <> 0 THEN strftime(make_timestamp((s + 1) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.623456789Z' END AS stop FROM n""",
)
def decimal_times(spark, sf_dir):
    m = F.col("k") % 6
    fraction = F.when(m == 0, "").when(m == 1, ".5").when(m == 2, ".000123").when(m == 3, ".123456789").when(m == 4, ".1234567891").otherwise(".25000000000")
    raw = F.concat(F.expr("ts_us div 1000000").cast("string"), fraction)
    length = F.when(F.col("k") % 4 == 0, "-1").otherwise("1.5")
    return views.alerts(spark, sf_dir).select("alert_id", times.decimal_utc(raw).alias("start"), times.decimal_utc(raw, length).alias("stop"))


@query(
    "stride_and_ticks",
    """WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), s AS (SELECT o_custkey, len(l) AS n, greatest(1, len(l) // 4) AS step, l FROM c)
    SELECT o_custkey, CAST(list_sum(list_transform(list_filter(range(0, n), lambda i: i % step = 0)[1:4], lambda i: l[i + 1])) AS BIGINT) AS picked, CAST(list_sum(list_distinct(list_concat(range(0, n, CAST(ceil(n / 6) AS BIGINT)), [n - 1]))) AS BIGINT) AS ticks FROM s""",
)
def stride_and_ticks(spark, sf_dir):
    rows = views.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select("o_custkey", total(samples.stride(F.col("l"), 4)).alias("picked"), total(samples.ticks(F.size("l"))).alias("ticks"))


@query(
    "visible_rows",
    """SELECT o_orderkey, CASE WHEN n > 0 THEN greatest(0, top // 20 - 3) ELSE 0 END AS first, CASE WHEN n > 0 THEN least(n, greatest(0, top // 20 - 3) + CASE WHEN h > 0 THEN CAST(ceil(h / 20.0) AS BIGINT) + 6 ELSE 6 END) ELSE 0 END AS last
    FROM (SELECT o_orderkey, greatest(o_orderkey % 4000 - 100, 0) AS top, o_custkey % 300 AS h, o_orderkey % 150 AS n FROM orders) t""",
)
def visible_rows(spark, sf_dir):
    rows = views.read(spark, sf_dir, "orders")
    shown = samples.visible_rows(F.col("o_orderkey") % 4000 - 100, F.col("o_custkey") % 300, F.col("o_orderkey") % 150, 20, 3)
    return rows.select("o_orderkey", shown.alias("s")).select("o_orderkey", F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"))


@query(
    "fingerprint_union",
    f"""WITH f AS ({FLOWS_SQL}) SELECT DISTINCT 'ja3s' AS kind, md5(cast(k % 40 AS VARCHAR)) AS value FROM f WHERE k % 8 = 1 UNION SELECT DISTINCT 'ja3', md5(cast(k % 40 AS VARCHAR)) FROM f WHERE k % 8 = 0 UNION SELECT DISTINCT 'ja4', concat('t13d_', k % 40) FROM f WHERE k % 8 = 2 UNION SELECT 'ja4', 'own_1'""",
)
def fingerprint_union(spark, sf_dir):
    """What a feed and a list of one's own have together, without lines that can't be used."""
    own = ops.fingerprint_feed(spark.createDataFrame([("ja4:OWN_1",), ("ja9:x",)], "value string"))
    return ops.fingerprints(fingerprint_feed(spark, sf_dir), own)
