"""Evaluation of scores, alerts and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import codes
from taplight.operators import evaluate
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import ALERTS_SQL, DAY_US, FLOWS_SQL, SEVERITY_SQL

_S = "s AS (SELECT least(n_chars, 4096) / 4096.0 AS score, quality AS label FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf_dir):
    joined = views.read(spark, sf_dir, "labels").join(views.read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select((F.least("n_chars", F.lit(4096)) / 4096.0).alias("score"), F.col("quality").alias("label"))


@query(
    "threshold_sweep",
    f"""WITH {_S}, t AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS threshold), c AS (SELECT threshold, count(CASE WHEN score >= threshold AND label = 1 THEN 1 END) AS tp, count(CASE WHEN score >= threshold AND label = 0 THEN 1 END) AS fp,
        count(CASE WHEN score < threshold AND label = 0 THEN 1 END) AS tn, count(CASE WHEN score < threshold AND label = 1 THEN 1 END) AS fn FROM s CROSS JOIN t GROUP BY threshold)
    SELECT threshold, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def threshold_sweep(spark, sf_dir):
    rows = evaluate.threshold_sweep(_scored(spark, sf_dir), [0.1, 0.25, 0.5, 0.75, 0.9])
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "binary_metrics",
    f"""WITH {_S}, p AS (SELECT score FROM s WHERE label = 1), n AS (SELECT score FROM s WHERE label = 0),
    g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score), r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
    SELECT round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM p CROSS JOIN n), 6) AS roc_auc,
           round((SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM r), 6) AS pr_auc, CAST((SELECT count(*) FROM p) AS BIGINT) AS positives, CAST((SELECT count(*) FROM n) AS BIGINT) AS negatives""",
)
def binary_metrics(spark, sf_dir):
    return evaluate.ranking_metrics(_scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"), F.col("positives").cast("long"), F.col("negatives").cast("long"))


@query(
    "latency_percentiles",
    f"""WITH f AS ({FLOWS_SQL}), m AS (SELECT proto, greatest(k * 1000 - 50000 + value, 0) AS ms FROM f WHERE k * 1000 - 50000 + value <= 300000), v AS (SELECT proto, list(ms ORDER BY ms) AS l, count(*) AS n FROM m GROUP BY proto)
    SELECT proto, n, l[CAST(least(floor(n * 0.5), n - 1) AS BIGINT) + 1] AS p50, l[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95, l[n] AS top, l[CAST(ceil(n * 0.9) AS BIGINT)] AS nearest90,
           l[CAST(greatest(floor(n * 0.05) - 1, 0) AS BIGINT) + 1] AS band5 FROM v""",
)
def latency_percentiles(spark, sf_dir):
    """All three percentile conventions, of latencies that are clipped at zero and not of another time."""
    places = evaluate.latency_places() | {"nearest90": evaluate.nearest_rank(0.9), "band5": evaluate.band_place(0.05)}
    rows = views.flows(spark, sf_dir).withColumn("ms", evaluate.usable_latency(F.col("k") * 1000 - 50000 + F.col("value")))
    return evaluate.order_statistics(rows, ["proto"], "ms", places)


@query(
    "population_sweep",
    f"""WITH f AS ({FLOWS_SQL}), t AS (SELECT unnest([10, 50, 100])::DOUBLE AS threshold) SELECT event_type, threshold, round(avg((value >= threshold)::INT), 6) AS share FROM f CROSS JOIN t GROUP BY ALL""",
)
def population_sweep(spark, sf_dir):
    rows = views.flows(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0))))
    return rows.groupBy("event_type", "threshold").agg(F.round(F.avg((F.col("value") >= F.col("threshold")).cast("int")), 6).alias("share"))


@query(
    "fp_report",
    f"""WITH a AS ({ALERTS_SQL}), s AS (SELECT threat_class, count(*) AS n, count(DISTINCT src) AS sources FROM a GROUP BY 1), t AS (SELECT count(*) AS flows, (max(ts_us) - min(ts_us)) / 3.6e9 AS hours FROM a),
    p0 AS (SELECT threat_class, src, count(*) AS n FROM a GROUP BY ALL), p AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY threat_class ORDER BY n DESC, src) <= 5), l AS (SELECT threat_class, string_agg(src, ',' ORDER BY n DESC, src) AS top FROM p GROUP BY 1)
    SELECT s.threat_class, s.n, s.sources, round(s.n * 1000.0 / t.flows, 4) AS per_1000, round(s.n / t.hours, 4) AS per_hour, l.top FROM s CROSS JOIN t JOIN l ON s.threat_class = l.threat_class""",
)
def fp_report(spark, sf_dir):
    a = views.alerts(spark, sf_dir)
    total = a.agg(F.count(F.lit(1)).alias("flows"), ((F.max("ts_us") - F.min("ts_us")) / 3.6e9).alias("hours"))
    by_source = a.groupBy("threat_class", "src").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("threat_class").orderBy(F.desc("n"), "src"))
    top = by_source.withColumn("place", place).where("place <= 5").groupBy("threat_class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "src"))), lambda x: x["src"]), ",").alias("top"))
    sums = by_source.groupBy("threat_class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"))
    return sums.join(top, "threat_class").join(F.broadcast(total)).select("threat_class", "n", "sources", F.round(F.col("n") * 1000.0 / F.col("flows"), 4).alias("per_1000"), F.round(F.col("n") / F.col("hours"), 4).alias("per_hour"), "top")


@query(
    "behaviour_matrix",
    f"""WITH a AS ({ALERTS_SQL}), c AS (SELECT threat_class, {SEVERITY_SQL.format('score')} AS severity FROM a)
    SELECT threat_class, count(CASE WHEN severity = 'low' THEN 1 END) AS low, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'high' THEN 1 END) AS high, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical FROM c GROUP BY 1""",
)
def behaviour_matrix(spark, sf_dir):
    rated = views.alerts(spark, sf_dir).withColumn("severity", codes.severity(F.col("score")))
    return rated.groupBy("threat_class").pivot("severity", list(codes.SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)


@query(
    "field_coverage",
    f"""WITH f AS ({FLOWS_SQL}) SELECT count(*) AS total, 'state' AS field, count(CASE WHEN state <> '' THEN 1 END) AS present FROM f UNION ALL SELECT count(*), 'orig_bytes', count(orig_bytes) FROM f UNION ALL SELECT count(*), 'src', count(src) FROM f""",
)
def field_coverage(spark, sf_dir):
    return evaluate.field_coverage(views.flows(spark, sf_dir), ["state", "orig_bytes", "src"])


@query(
    "capability_tally",
    f"""WITH f AS ({FLOWS_SQL}) SELECT count(*) AS flows, count(CASE WHEN state IS NULL THEN 1 END) AS no_state, count(CASE WHEN orig_bytes IS NULL THEN 1 END) AS no_bytes, count(CASE WHEN proto = 'udp' THEN 1 END) AS udp, count(DISTINCT src) AS sources FROM f""",
)
def capability_tally(spark, sf_dir):
    return views.flows(spark, sf_dir).agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("state").isNull()).alias("no_state"), F.count_if(F.col("orig_bytes").isNull()).alias("no_bytes"), F.count_if(F.col("proto") == "udp").alias("udp"), F.count_distinct("src").alias("sources"))


@query(
    "throughput_sample",
    f"""WITH f AS ({FLOWS_SQL}) SELECT ts_us // 3600000000 AS hour, round(count(*) / 3600.0, 6) AS flows_s, round(sum(orig_pkts) / 3600.0, 6) AS packets_s, round(coalesce(sum(orig_bytes), 0) * 8 / 1e6 / 3600.0, 6) AS mb_s FROM f GROUP BY 1""",
)
def throughput_sample(spark, sf_dir):
    by_hour = views.flows(spark, sf_dir).groupBy(F.expr("ts_us div 3600000000").alias("hour"))
    return by_hour.agg(F.round(F.count(F.lit(1)) / 3600.0, 6).alias("flows_s"), F.round(F.sum("orig_pkts") / 3600.0, 6).alias("packets_s"), F.round(F.coalesce(F.sum("orig_bytes"), F.lit(0)) * 8 / 1e6 / 3600.0, 6).alias("mb_s"))


@query(
    "run_length",
    """WITH g AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, n ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, CAST(sum(n) AS BIGINT) AS amount, count(*) AS rows FROM r GROUP BY conv_id, run""",
)
def run_length(spark, sf_dir):
    turns = views.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("amount"))
    return evaluate.collapse_runs(turns, ["conv_id"], ["turn", "amount"], "role", "amount")


@query(
    "service_matrix",
    f"""WITH f AS ({FLOWS_SQL}), r AS (SELECT src, port, dense_rank() OVER (PARTITION BY src ORDER BY port) AS col, ts_us // {DAY_US} AS day FROM f)
    SELECT src, CAST(col AS INT) AS col, day, count(*) AS n FROM r GROUP BY ALL""",
)
def service_matrix(spark, sf_dir):
    """Ports as columns by rank, days as rows."""
    from pyspark.sql import Window

    ranked = views.flows(spark, sf_dir).select("src", F.dense_rank().over(Window.partitionBy("src").orderBy("port")).alias("col"), F.expr(f"ts_us div {DAY_US}").alias("day"))
    return ranked.groupBy("src", "col", "day").agg(F.count(F.lit(1)).alias("n"))
