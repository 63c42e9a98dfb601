"""The rules over flows derived from the driver's tables, with spans and thresholds that fit their rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import text
from taplight.operators import detectors
from taplight.operators.emit import cooldown
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import CLASSIFIED_SQL, COMPLETE_SQL, DAY_US, DNS_SQL, FLOWS_SQL, RANK_SQL, SEVERITY_SQL

HOUR = DAY_US // 24


def fold_sql(candidates: str, key: str, cooldown_us: int, identifier: str, columns: str, setup: str) -> str:
    """Candidates (with score) folded by cooldown and escalation, row after row."""
    return f"""WITH RECURSIVE {setup}, c0 AS ({candidates}), c AS (SELECT *, {RANK_SQL.format("score")} AS rank, {SEVERITY_SQL.format("score")} AS severity FROM c0),
    n AS (SELECT *, {key} AS fkey, row_number() OVER (PARTITION BY {key} ORDER BY ts_us, {identifier}) AS rn FROM c),
    f AS (SELECT fkey, rn, ts_us AS last, rank AS lrank, TRUE AS emit FROM n WHERE rn = 1
          UNION ALL SELECT n.fkey, n.rn, CASE WHEN n.ts_us - f.last >= {cooldown_us} OR n.rank > f.lrank THEN n.ts_us ELSE f.last END,
                 CASE WHEN n.ts_us - f.last >= {cooldown_us} OR n.rank > f.lrank THEN n.rank ELSE f.lrank END, n.ts_us - f.last >= {cooldown_us} OR n.rank > f.lrank
          FROM f JOIN n ON n.fkey = f.fkey AND n.rn = f.rn + 1)
    SELECT {columns} FROM n JOIN f ON n.fkey = f.fkey AND n.rn = f.rn WHERE f.emit"""


_SCORE = "round(greatest(least({0}, 1.0), 0.0), 6)"
_OUT = "flow_id, ts_us, score, severity"

FLOOD = detectors.Flood(window_us=6 * HOUR, cooldown_us=12 * HOUR, sources=12, flows=14, packets=100)


@query(
    "det_flood",
    fold_sql(
        f"SELECT *, {_SCORE.format('0.5 + 0.5 * ((sources / 12.0 + greatest(n / 14.0, coalesce(packets, 0) / 100.0)) / 2 - 1) / 3')} AS score FROM w WHERE sources >= 12 AND (n >= 14 OR packets >= 100)",
        "dst",
        12 * HOUR,
        "flow_id",
        f"{_OUT}, sources, n AS flows",
        f"flows AS ({FLOWS_SQL}), w AS (SELECT *, count(DISTINCT src) OVER v AS sources, count(*) OVER v AS n, sum(orig_pkts) OVER v AS packets FROM flows WINDOW v AS (PARTITION BY dst ORDER BY ts_us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW))",
    ),
)
def det_flood(spark, sf_dir):
    return FLOOD(views.flows(spark, sf_dir)).select(*_OUT.split(", "), "sources", "flows")


SCAN = detectors.Scan(window_us=3 * DAY_US, cooldown_us=DAY_US, ports=5, service_ports=3, fanout=2, answered=0.6)


@query(
    "det_scan",
    fold_sql(
        f"""SELECT *, {_SCORE.format("0.5 + 0.5 * (greatest(CASE WHEN v THEN ports / 5.0 ELSE 0 END, CASE WHEN h THEN fanout / 2.0 ELSE 0 END) - 1) / 3 + CASE WHEN v AND h THEN 0.10 ELSE 0 END")} AS score
        FROM (SELECT *, ports >= 5 AND service_ports >= 3 AS v, fanout >= 2 AS h FROM q) t WHERE (v OR h) AND CASE WHEN coverage >= 0.5 THEN coalesce(incomplete, 0) >= 0.05 ELSE answered <= 0.6 END""",
        "src",
        DAY_US,
        "flow_id",
        f"{_OUT}, ports, fanout",
        f"""flows AS ({FLOWS_SQL}),
        e AS (SELECT a.flow_id, b.dst, b.port, max(CASE WHEN b.state IN {CLASSIFIED_SQL} THEN 1 ELSE 0 END) AS known, max(CASE WHEN b.state IN {COMPLETE_SQL} THEN 1 ELSE 0 END) AS complete, max(CASE WHEN b.resp_bytes >= 100 THEN 1 ELSE 0 END) AS answered
              FROM flows a JOIN flows b ON a.src = b.src AND b.ts_us > a.ts_us - {3 * DAY_US} AND b.ts_us <= a.ts_us GROUP BY ALL),
        s AS (SELECT flow_id, count(DISTINCT port) AS ports, count(DISTINCT CASE WHEN port <= 49151 THEN port END) AS service_ports, avg(known) AS coverage, sum(CASE WHEN known = 1 AND complete = 0 THEN 1 ELSE 0 END) / nullif(sum(known), 0) AS incomplete, avg(answered) AS answered FROM e GROUP BY flow_id),
        p AS (SELECT flow_id, max(n) AS fanout FROM (SELECT flow_id, port, count(DISTINCT dst) AS n FROM e GROUP BY ALL) t GROUP BY flow_id),
        q AS (SELECT flows.*, s.ports, s.service_ports, s.coverage, s.incomplete, s.answered, p.fanout FROM flows JOIN s USING (flow_id) JOIN p USING (flow_id))""",
    ),
)
def det_scan(spark, sf_dir):
    return SCAN(views.flows(spark, sf_dir)).select(*_OUT.split(", "), "ports", "fanout")


BEACON = detectors.Beacon(window_us=2 * DAY_US, cooldown_us=DAY_US, contacts=5, least_s=100, most_s=1e6, variation=0.9, mean_bytes=400_000)


@query(
    "det_beacon",
    fold_sql(
        f"""SELECT *, {_SCORE.format("0.5 + 0.5 * (0.6 * greatest(least(1 - cv / 0.9, 1), 0) + 0.4 * greatest(least(((n_gaps + 1) / 5.0 - 1) / 3, 1), 0))")} AS score FROM m
        WHERE contacts >= 5 AND n_gaps >= 4 AND mean_gap BETWEEN 100 AND 1e6 AND cv <= 0.9 AND coalesce(mean_sent, 0) <= 400000""",
        "concat_ws('|', src, dst, port, proto)",
        DAY_US,
        "flow_id",
        f"{_OUT}, n_gaps",
        f"""base AS ({FLOWS_SQL}), flows AS (SELECT * FROM (SELECT flow_id, ts_us, concat('10.0.0.', user_id % 10) AS src, CASE WHEN k % 40 = 39 THEN '239.255.255.250' ELSE concat('192.168.1.', k % 2) END AS dst, [4444, 4444, 4444, 4444, 4444, 4444, 4444, 53, 161, 162, 514, 445, 67, 68, 123, 137, 138, 389, 636, 1900, 3268, 3269, 5353, 5355][1 + user_id % 24] AS port, proto, orig_bytes FROM base) t
             WHERE port NOT IN (67, 68, 123, 137, 138, 389, 636, 1900, 3268, 3269, 5353, 5355) AND dst NOT LIKE '239.%'),
        o AS (SELECT *, lag(ts_us) OVER (PARTITION BY src, dst, port, proto ORDER BY ts_us) AS prev FROM flows),
        g AS (SELECT a.flow_id, avg(b.orig_bytes) AS mean_sent, count(*) AS contacts, count(CASE WHEN b.prev > a.ts_us - {2 * DAY_US} THEN 1 END) AS n_gaps,
                     avg(CASE WHEN b.prev > a.ts_us - {2 * DAY_US} THEN (b.ts_us - b.prev) / 1e6 END) AS mean_gap, stddev_pop(CASE WHEN b.prev > a.ts_us - {2 * DAY_US} THEN (b.ts_us - b.prev) / 1e6 END) AS sd
              FROM o a JOIN o b ON a.src = b.src AND a.dst = b.dst AND a.port = b.port AND a.proto = b.proto AND b.ts_us > a.ts_us - {2 * DAY_US} AND b.ts_us <= a.ts_us GROUP BY a.flow_id),
        m AS (SELECT flows.*, g.mean_sent, g.contacts, g.n_gaps, g.mean_gap, g.sd / g.mean_gap AS cv FROM flows JOIN g USING (flow_id))""",
    ),
)
def det_beacon(spark, sf_dir):
    ports = F.array(*map(F.lit, [4444] * 7 + [53, 161, 162, 514, 445, 67, 68, 123, 137, 138, 389, 636, 1900, 3268, 3269, 5353, 5355]))
    dst = F.when(F.col("k") % 40 == 39, "239.255.255.250").otherwise(F.concat(F.lit("192.168.1."), F.col("k") % 2))
    flows = views.flows(spark, sf_dir).select("flow_id", "ts_us", F.concat(F.lit("10.0.0."), F.col("user_id") % 10).alias("src"), dst.alias("dst"), F.get(ports, (F.col("user_id") % 24).cast("int")).alias("port"), "proto", "orig_bytes")
    return BEACON(flows).select(*_OUT.split(", "), F.col("n_gaps").cast("long").alias("n_gaps"))


OUTBOUND = detectors.Outbound(window_us=4 * DAY_US, cooldown_us=DAY_US, concentration=0.4, total_bytes=60_000, rows=2, single_bytes=150_000)


@query(
    "det_outbound",
    fold_sql(
        f"""SELECT *, {_SCORE.format("0.5 + 0.5 * (greatest(CASE WHEN sus THEN (least(pair_bytes / 60000.0, 4) + least(pair_rows / 2.0, 4)) / 2 ELSE 0 END, CASE WHEN sin THEN least(largest / 150000.0, 4) ELSE 0 END) - 1) / 3 + 0.10 * greatest(least((conc - 0.4) / 0.6, 1), 0)")} AS score
        FROM (SELECT *, coalesce(pair_bytes >= 60000 AND pair_rows >= 2, FALSE) AS sus, coalesce(largest >= 150000, FALSE) AS sin, CASE WHEN source_bytes > 0 THEN least(pair_bytes / source_bytes, 1.0) WHEN source_bytes IS NOT NULL THEN 0 END AS conc FROM w) t WHERE conc >= 0.4 AND (sus OR sin)""",
        "concat_ws('|', src, dst)",
        DAY_US,
        "flow_id",
        f"{_OUT}, CAST(pair_bytes AS BIGINT) AS pair_bytes",
        f"""flows AS ({FLOWS_SQL}), w AS (SELECT *, CASE WHEN count(orig_bytes) OVER p = count(*) OVER p THEN sum(orig_bytes) OVER p END AS pair_bytes, count(*) OVER p AS pair_rows,
             CASE WHEN count(orig_bytes) OVER p = count(*) OVER p THEN max(orig_bytes) OVER p END AS largest, CASE WHEN count(orig_bytes) OVER s = count(*) OVER s THEN sum(orig_bytes) OVER s END AS source_bytes
             FROM flows WINDOW p AS (PARTITION BY src, dst ORDER BY ts_us RANGE BETWEEN {4 * DAY_US - 1} PRECEDING AND CURRENT ROW), s AS (PARTITION BY src ORDER BY ts_us RANGE BETWEEN {4 * DAY_US - 1} PRECEDING AND CURRENT ROW))""",
    ),
)
def det_outbound(spark, sf_dir):
    return OUTBOUND(views.flows(spark, sf_dir)).select(*_OUT.split(", "), "pair_bytes")


TUNNEL = detectors.DnsTunnel(window_us=300_000_000, cooldown_us=300_000_000, rows=3, signals=1, suspicious=0.4, length=24, entropy=3.6, subdomain_entropy=2.8, labels=4)


@query(
    "det_dns",
    fold_sql(
        f"""SELECT *, {_SCORE.format("0.5 + 0.5 * (0.5 * greatest(least((odd / n - 0.5) / 0.5, 1), 0) + 0.25 * greatest(least((n / 3.0 - 1) / 2, 1), 0) + 0.25 * greatest(least((sums / odd - 2) / 3.0, 1), 0)) + CASE WHEN txt >= 0.30 THEN 0.10 ELSE 0 END")} AS score
        FROM w WHERE n >= 3 AND odd / n >= 0.4""",
        "concat_ws('|', src, resolver)",
        300_000_000,
        "page_id",
        "page_id, ts_us, score, severity",
        f"""d AS ({DNS_SQL}), e AS (SELECT *, length(query) AS len, len(string_split(rtrim(query, '.'), '.')) AS labels FROM d),
        x AS (SELECT *, CASE WHEN labels > 2 THEN array_to_string(string_split(rtrim(query, '.'), '.')[1:labels - 2], '.') ELSE '' END AS sub FROM e),
        y AS (SELECT *, coalesce((SELECT -sum(c / length(query) * log2(c / length(query))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(query, '')) AS ch) GROUP BY ch)), 0) AS h,
              coalesce((SELECT -sum(c / length(sub) * log2(c / length(sub))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(sub, '')) AS ch) WHERE sub <> '' GROUP BY ch)), 0) AS hs FROM x),
        z AS (SELECT *, (len >= 24)::INT + (h >= 3.6)::INT + (hs >= 2.8)::INT + (labels >= 4)::INT + (qtype = 'TXT')::INT AS signals FROM y),
        w AS (SELECT *, count(*) OVER v AS n, sum((signals >= 1)::INT) OVER v AS odd, sum(CASE WHEN signals >= 1 THEN signals END) OVER v AS sums, avg((qtype = 'TXT')::INT) OVER v AS txt
              FROM z WINDOW v AS (PARTITION BY src, resolver ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW))""",
    ),
)
def det_dns(spark, sf_dir):
    q = F.col("query")
    names = views.dns(spark, sf_dir).withColumns({"query_length": F.char_length(q), "query_entropy": text.entropy(q), "subdomain_entropy": text.subdomain_entropy(q), "label_count": text.label_count(q), "is_txt": F.upper("qtype") == "TXT"})
    return TUNNEL(names).select("page_id", "ts_us", "score", "severity")


_TLS = f"""SELECT flow_id, ts_us, src, dst, CASE WHEN k % 4 = 0 THEN NULL ELSE concat('JA3-', k % 9) END AS ja3, concat('ja3s-', k % 5) AS ja3s, concat('t13d', k % 6) AS ja4,
       CAST(30 + k % 20 AS INT) AS sni_length, 3.5 + (k % 10) / 10.0 AS sni_entropy, CASE WHEN k % 5 = 0 THEN 'TLSv10' WHEN k % 5 = 1 THEN NULL ELSE 'TLSv13' END AS version"""


def _handshakes(spark, sf_dir):
    views.flows(spark, sf_dir).createOrReplaceTempView("tl_handshakes")
    return spark.sql(f"{_TLS} FROM tl_handshakes")


@query(
    "det_tls_sig",
    fold_sql(
        "SELECT *, 1.0 AS score FROM (SELECT flow_id, ts_us, src, dst, 'ja3' AS kind, lower(trim(ja3)) AS value FROM t UNION ALL SELECT flow_id, ts_us, src, dst, 'ja3s', lower(ja3s) FROM t UNION ALL SELECT flow_id, ts_us, src, dst, 'ja4', lower(ja4) FROM t) u WHERE (kind, value) IN (SELECT kind, value FROM feed)",
        "concat_ws('|', src, dst, kind, value)",
        2 * DAY_US,
        "flow_id",
        "flow_id, kind, value, severity",
        f"""flows AS ({FLOWS_SQL}), t AS ({_TLS} FROM flows), feed AS (SELECT * FROM (VALUES ('ja3', 'ja3-3'), ('ja3', 'ja3-7'), ('ja3s', 'ja3s-2'), ('ja4', 't13d5')) v(kind, value))""",
    ),
)
def det_tls_sig(spark, sf_dir):
    feed = spark.createDataFrame([("ja3", " JA3-3"), ("ja3", "ja3-7"), ("JA3", "ja3-7"), ("ja3s", "ja3s-2"), ("ja4", "T13D5")], "kind string, value string")
    return detectors.fingerprint_hits(_handshakes(spark, sf_dir), feed, 2 * DAY_US).select("flow_id", "kind", "value", "severity")


TLS = detectors.TlsMetadata(window_us=5 * DAY_US, cooldown_us=DAY_US, rows=2, suspicious=0.5, sni_length=38, sni_entropy=3.9)


@query(
    "det_tls_meta",
    fold_sql(
        f"""SELECT *, {_SCORE.format("0.5 + 0.5 * (0.6 * greatest(least((odd - 0.6) / 0.4, 1), 0) + 0.4 * greatest(least((n / 2.0 - 1) / 2, 1), 0)) + CASE WHEN obs >= 0.5 THEN 0.10 ELSE 0 END")} AS score FROM w WHERE n >= 2 AND odd >= 0.5""",
        "concat_ws('|', src, dst)",
        DAY_US,
        "flow_id",
        _OUT,
        f"""flows AS ({FLOWS_SQL}), t AS ({_TLS} FROM flows), w AS (SELECT *, count(*) OVER v AS n, avg((sni_length >= 38 AND sni_entropy >= 3.9)::INT) OVER v AS odd, avg((version IN ('SSLv3','TLSv10','TLSv11'))::INT) OVER v AS obs
            FROM t WINDOW v AS (PARTITION BY src, dst ORDER BY ts_us RANGE BETWEEN {5 * DAY_US - 1} PRECEDING AND CURRENT ROW))""",
    ),
)
def det_tls_meta(spark, sf_dir):
    return TLS(_handshakes(spark, sf_dir)).select(*_OUT.split(", "))


@query(
    "det_generated",
    f"""WITH RECURSIVE d AS ({DNS_SQL}), s AS (SELECT page_id AS flow_id, ts_us, src, query AS domain, length(replace(query, '.', '')) / 40.0 AS model_score FROM d WHERE length(replace(query, '.', '')) / 40.0 >= 0.5),
    r AS (SELECT *, round(greatest(least(0.5 + 0.5 * (model_score - 0.5) / 0.5, 1.0), 0.0), 6) AS score FROM s), k AS (SELECT *, {RANK_SQL.format("score")} AS rank, {SEVERITY_SQL.format("score")} AS severity FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY src, domain ORDER BY ts_us, flow_id) AS rn FROM k),
    f AS (SELECT src, domain, rn, ts_us AS last, rank AS lrank, TRUE AS emit FROM n WHERE rn = 1 UNION ALL SELECT n.src, n.domain, n.rn, CASE WHEN n.ts_us - f.last >= 300000000 OR n.rank > f.lrank THEN n.ts_us ELSE f.last END, CASE WHEN n.ts_us - f.last >= 300000000 OR n.rank > f.lrank THEN n.rank ELSE f.lrank END, n.ts_us - f.last >= 300000000 OR n.rank > f.lrank FROM f JOIN n ON n.src = f.src AND n.domain = f.domain AND n.rn = f.rn + 1),
    e AS (SELECT n.* EXCLUDE (rn) FROM n JOIN f ON n.src = f.src AND n.domain = f.domain AND n.rn = f.rn WHERE f.emit),
    w AS (SELECT *, count(DISTINCT domain) OVER (PARTITION BY src ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS n_domains, row_number() OVER (PARTITION BY src ORDER BY ts_us, flow_id) AS rn FROM e),
    g AS (SELECT src, rn, ts_us AS last, rank AS lrank, TRUE AS emit FROM w WHERE rn = 1 UNION ALL SELECT w.src, w.rn, CASE WHEN w.ts_us - g.last >= 300000000 OR w.rank > g.lrank THEN w.ts_us ELSE g.last END, CASE WHEN w.ts_us - g.last >= 300000000 OR w.rank > g.lrank THEN w.rank ELSE g.lrank END, w.ts_us - g.last >= 300000000 OR w.rank > g.lrank FROM g JOIN w ON w.src = g.src AND w.rn = g.rn + 1)
    SELECT w.flow_id, w.domain, w.score, w.severity, CAST(w.n_domains AS INT) AS n_domains,
           (SELECT array_to_string(list_sort(list(DISTINCT e.domain))[1:10], ',') FROM e WHERE e.src = w.src AND e.ts_us > w.ts_us - 300000000 AND e.ts_us <= w.ts_us) AS sample FROM w JOIN g ON w.src = g.src AND w.rn = g.rn WHERE g.emit""",
)
def det_generated(spark, sf_dir):
    """Reports on sources of generated names; the score here is a measure of length, the forest is in text_queries."""
    scored = views.dns(spark, sf_dir).select(F.col("page_id").alias("flow_id"), "ts_us", "src", F.col("query").alias("domain"), (F.char_length(F.replace("query", F.lit("."), F.lit(""))) / 40.0).alias("model_score"))
    return detectors.generated_domains(scored, 0.5).select("flow_id", "domain", "score", "severity", F.col("n_domains").cast("int").alias("n_domains"), F.array_join("sample", ",").alias("sample"))


@query(
    "cooldown_fold",
    fold_sql("SELECT alert_id, ts_us, src, score FROM a", "src", 6 * HOUR, "alert_id", "alert_id, src, severity", f"a AS ({views.ALERTS_SQL})"),
)
def cooldown_fold(spark, sf_dir):
    from taplight.functions import codes

    rated = views.alerts(spark, sf_dir).withColumn("severity", codes.severity(F.col("score"))).withColumn("rank", codes.severity_rank(F.col("severity")))
    return cooldown(rated, ["src"], 6 * HOUR, arrival="alert_id").select("alert_id", "src", "severity")


@query(
    "behaviour_labels",
    f"""WITH flows AS ({FLOWS_SQL}), s AS (SELECT src, count(DISTINCT port) AS ports, count(DISTINCT dst) AS ips, avg((state = 'S0')::INT) AS syn FROM flows GROUP BY src)
    SELECT src, CASE WHEN ports >= 50 AND ips <= 3 THEN 'vertical' WHEN ips >= 20 AND ports <= 5 THEN 'horizontal' WHEN ports >= 20 AND ips >= 20 THEN 'block' ELSE 'mixed' END AS pattern,
           CASE WHEN ports / 8.0 >= 5 THEN 'amplification' WHEN ports / 4.0 >= 6 AND syn >= 0.7 THEN 'spoofed' WHEN ports / 4.0 < 3 THEN 'direct' ELSE 'mixed' END AS flood FROM s""",
)
def behaviour_labels(spark, sf_dir):
    s = views.flows(spark, sf_dir).groupBy("src").agg(F.count_distinct("port").alias("ports"), F.count_distinct("dst").alias("ips"), F.avg((F.col("state") == "S0").cast("int")).alias("syn"))
    return s.select("src", detectors.scan_pattern(F.col("ports"), F.col("ips")).alias("pattern"), detectors.flood_signature(F.col("ports") / 4.0, F.col("syn"), F.col("ports") / 8.0).alias("flood"))
