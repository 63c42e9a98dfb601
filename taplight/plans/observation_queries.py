"""Canonical observations of logs and exported flows, from lines and datagrams that Spark derives from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import ids
from taplight.plans.catalog import query
from taplight.plans.format_queries import _number
from taplight.sources import netflow, observations, shared, views, zeek
from taplight.sources.views import FLOWS_SQL

_F = f"f AS ({FLOWS_SQL})"
_ENDS = ("ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "ip_proto")
CONN = zeek.Header((*_ENDS, "duration", "orig_bytes", "orig_pkts", "resp_bytes", "conn_state", "missed_bytes"))
DNS = zeek.Header((*_ENDS, "query", "qtype"))
SSL = zeek.Header((*_ENDS, "server_name"))
ORIGIN = observations.Origin("s1", "ab" * 32, "2024-01-01T00:00:00Z")

_TS = "concat(CAST(ts_us div 1000000 AS STRING), '.5')"
_UID = "concat('C', CAST(flow_id % 500 AS STRING))"


def _lines(spark, sf_dir, cells: list[str]):
    """Lines of the cells; a source is its user's address, for the view's text is none from user 256 on."""
    rows = views.flows(spark, sf_dir).withColumn("src", F.coalesce(views.address(F.col("user_id")), F.lit("-")))
    return rows.select(F.col("flow_id").alias("ordinal"), F.concat_ws("\t", *map(F.expr, cells)).alias("value"))


def _conn(spark, sf_dir):
    ends = [f"CASE WHEN k % 29 = 0 THEN '-' ELSE {_TS} END", _UID, "CASE WHEN k % 13 = 0 THEN '10.0.0.256' ELSE src END", "CAST(1024 + k % 9 AS STRING)", "dst", "CAST(port AS STRING)", "CASE WHEN k % 10 = 3 THEN 'sctp' ELSE proto END", "CASE WHEN k % 11 = 0 THEN '47' ELSE '-' END"]
    return _lines(spark, sf_dir, [*ends, "CASE WHEN k % 7 = 0 THEN '-1' WHEN k % 7 = 1 THEN '-' ELSE '2.25' END", "CASE WHEN k % 17 = 0 THEN '-' ELSE '10' END", "'-'", "CAST(resp_bytes AS STRING)", "coalesce(state, '-')", "CASE WHEN k % 5 = 0 THEN '3' ELSE '0' END"])


def _flows(spark, sf_dir):
    """Observations of connections, written once for those who are linked to them."""
    return shared.written(observations.produce(_conn(spark, sf_dir), CONN, "conn", ORIGIN), "flows")


_REASON = "CASE WHEN k % 29 = 0 THEN 'time' WHEN k % 13 = 0 THEN 'src_ip' WHEN k % 10 = 3 AND k % 11 <> 0 THEN 'protocol' WHEN k % 17 = 0 THEN 'counters' END"
_SQL_ID = f"sha1(unhex('{ids.NAMESPACE.hex}') || {' || '.join(f'unhex(lpad(hex(strlen({p})), 8, chr(48))) || encode({p})' for p in (repr('record-id-v1'), repr('s1'), repr('ab' * 32), repr('flow'), repr('conn'), 'uid', 'cast(flow_id AS VARCHAR)'))})"


@query(
    "flow_observations",
    f"""WITH {_F}, g AS (SELECT *, concat('C', flow_id % 500) AS uid, {_REASON} AS reason, CASE WHEN k % 11 = 0 THEN 47 WHEN proto = 'tcp' THEN 6 WHEN proto = 'udp' THEN 17 ELSE 1 END AS number, strftime(make_timestamp(ts_us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') AS t FROM f)
    SELECT flow_id AS ordinal, reason, CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN k % 11 = 0 AND k % 10 <> 3 THEN 'conflict' END, CASE WHEN k % 7 = 0 THEN 'duration' END) ELSE '' END AS notes, k % 5 = 0 AS loss_detected,
    CASE WHEN reason IS NULL THEN t || '.500Z' END AS start_time, CASE WHEN reason IS NULL AND k % 7 > 1 THEN strftime(make_timestamp((ts_us // 1000000 + 2) * 1000000), '%Y-%m-%dT%H:%M:%S') || '.750Z' END AS end_time,
    CASE WHEN reason IS NULL THEN number END AS ip_protocol, CASE WHEN reason IS NULL AND number <> 1 THEN port END AS dst_port, CASE WHEN reason IS NULL THEN state END AS connection_state, CASE WHEN reason IS NULL THEN {_SQL_ID}[1:8] END AS id_begins FROM g""",
)
def flow_observations(spark, sf_dir):
    rows = _flows(spark, sf_dir)
    return rows.select("ordinal", "reason", F.array_join("notes", ",").alias("notes"), "loss_detected", "flow.start_time", "flow.end_time", "flow.ip_protocol", "flow.dst_port", "flow.connection_state", F.substring("record_id", 1, 8).alias("id_begins"))


def _dns(spark, sf_dir):
    return _lines(spark, sf_dir, [_TS, _UID, "src", "'-'", "CASE WHEN k % 6 = 0 THEN '9.9.9.9' ELSE dst END", "CAST(port AS STRING)", "proto", "'-'", "CASE WHEN k % 3 = 0 THEN '(empty)' ELSE 'a.example' END", "'1'"])


_CONN_SQL = f"c AS (SELECT concat('C', flow_id % 500) AS uid, flow_id, src, dst, CASE WHEN k % 11 = 0 THEN 47 WHEN proto = 'tcp' THEN 6 WHEN proto = 'udp' THEN 17 ELSE 1 END AS number, CASE WHEN CASE WHEN k % 11 = 0 THEN 'x' ELSE proto END <> 'icmp' THEN port END AS port FROM f WHERE {_REASON} IS NULL)"


@query(
    "dns_observations",
    f"""WITH {_F}, {_CONN_SQL}, d AS (SELECT flow_id AS ordinal, concat('C', flow_id % 500) AS uid, src, CASE WHEN k % 6 = 0 THEN '9.9.9.9' ELSE dst END AS dst, port, CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 END AS number, CASE WHEN k % 3 = 0 THEN '' ELSE 'a.example' END AS query FROM f),
    m AS (SELECT d.ordinal, count(c.uid) AS near, count(CASE WHEN c.src = d.src AND c.dst = d.dst AND c.number = d.number AND (c.port = d.port OR c.port IS NULL OR d.port IS NULL) THEN 1 END) AS fit FROM d LEFT JOIN c ON c.uid = d.uid GROUP BY 1)
    SELECT d.ordinal, CASE WHEN d.number IS NULL THEN 'protocol' END AS reason, CASE WHEN d.number IS NULL THEN '' WHEN m.fit > 1 THEN 'ambiguous_flow' WHEN m.fit = 0 AND m.near > 0 THEN 'inconsistent_flow' ELSE '' END AS notes, CASE WHEN d.number IS NOT NULL THEN d.query END AS query, d.number IS NOT NULL AND m.fit = 1 AS linked FROM d JOIN m ON d.ordinal = m.ordinal""",
)
def dns_observations(spark, sf_dir):
    rows = observations.produce(_dns(spark, sf_dir), DNS, "dns", ORIGIN, _flows(spark, sf_dir))
    return rows.select("ordinal", "reason", F.array_join("notes", ",").alias("notes"), "dns.query", F.coalesce(F.col("dns.flow_record_id").isNotNull(), F.lit(False)).alias("linked"))


def _ssl(spark, sf_dir):
    return _lines(spark, sf_dir, [_TS, _UID, "src", "CAST(1024 + k % 9 AS STRING)", "dst", "CAST(port AS STRING)", "CASE WHEN k % 2 = 0 THEN '-' ELSE proto END", "'-'", "'h.example'"])


@query(
    "observation_kinds",
    f"""WITH {_F}, {_CONN_SQL}, d AS (SELECT flow_id AS ordinal, concat('C', flow_id % 500) AS uid, src, dst, CASE WHEN k % 2 = 1 THEN CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 END END AS number FROM f),
    m AS (SELECT d.ordinal, any_value(d.number) AS number, count(c.uid) AS n, min(c.number) AS found FROM d LEFT JOIN c ON c.uid = d.uid AND c.src = d.src AND c.dst = d.dst GROUP BY 1)
    SELECT 'flow' AS observation_type, 0 AS kind_rank, count(*) AS n FROM c UNION ALL SELECT 'dns', 1, count(*) FROM f WHERE proto <> 'icmp' UNION ALL SELECT 'tls', 2, count(*) FROM m WHERE coalesce(number, CASE WHEN n = 1 THEN found END) IS NOT NULL""",
)
def observation_kinds(spark, sf_dir):
    flows = _flows(spark, sf_dir)
    parts = {"conn": flows, "dns": observations.produce(_dns(spark, sf_dir), DNS, "dns", ORIGIN, flows), "ssl": observations.produce(_ssl(spark, sf_dir), SSL, "ssl", ORIGIN, flows)}
    return observations.together(parts).groupBy("observation_type", "kind_rank").agg(F.count(F.lit(1)).alias("n"))


def _v9(spark, sf_dir):
    """One template and one record to a datagram; some records lack, repeat or distort fields."""
    k = F.col("k")
    field = lambda i, size: F.concat(_number(F.lit(i), 2), _number(F.lit(size), 2))
    protocol = F.when(F.col("proto") == "tcp", 6).when(F.col("proto") == "udp", 17).otherwise(1)
    six = k % 9 == 4
    parts = [
        (8, 4, F.concat(F.lit("0a0000"), _number(k % 250, 1)), ~six), (12, 4, F.concat(F.lit("c0a801"), _number(k % 7, 1)), ~six),
        (27, 16, F.concat(F.lit("20010db8"), F.lit("0" * 8), _number(k % 250, 8)), six), (28, 16, F.lit("0" * 31 + "1"), six), (60, 1, F.lit("06"), six & (k % 2 == 0)),
        (4, 1, _number(protocol, 1), k % 16 != 5), (7, 2, F.lit("1388"), F.lit(True)), (11, 2, _number(F.col("port"), 2), F.lit(True)), (32, 2, F.lit("0801"), F.lit(True)), (6, 1, F.lit("12"), F.lit(True)),
        (22, 4, _number(F.lit(60_000), 4), F.lit(True)), (21, 4, _number(F.when(k % 19 == 7, 59_000).otherwise(90_000), 4), F.lit(True)), (2, 4, _number(F.col("orig_pkts"), 4), k % 21 != 8), (2, 4, _number(F.col("orig_pkts") + F.when(k % 2 == 0, 0).otherwise(1), 4), k % 12 == 6), (1, 4, _number(F.col("resp_bytes"), 4), F.lit(True)), (10, 2, _number(k % 3, 2), F.lit(True)),
    ]
    template = F.concat(*(F.when(there, field(i, size)).otherwise("") for i, size, _, there in parts))
    body = F.concat(*(F.when(there, value).otherwise("") for _, _, value, there in parts))
    n = F.length(template) / 8
    flowset = F.concat(F.lit("0000"), _number((8 + n * 4).cast("int"), 2), F.lit("0100"), _number(n.cast("int"), 2), template)
    data = F.concat(F.lit("0100"), _number((4 + F.length(body) / 2).cast("int"), 2), body)
    head = F.concat(F.lit("00090002"), _number(F.lit(100_000), 4), _number(F.expr("ts_us div 1000000"), 4), _number(F.col("flow_id"), 4), F.lit("00000007"))
    return views.flows(spark, sf_dir).select(F.concat(F.lit("e"), k % 5).alias("exporter"), F.col("flow_id").alias("ordinal"), F.unhex(F.concat(head, flowset, data)).alias("payload"))


@query(
    "v9_normal",
    f"""WITH {_F}, r AS (SELECT *, CASE WHEN k % 12 = 6 AND k % 2 = 1 THEN 'ambiguous_field' WHEN k % 16 = 5 THEN 'protocol' WHEN k % 9 = 4 AND k % 2 = 1 THEN 'address_family' WHEN k % 19 = 7 THEN 'time_order' WHEN k % 21 = 8 AND k % 12 <> 6 THEN 'counters' END AS reason FROM f)
    SELECT flow_id AS ordinal, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN CASE WHEN k % 9 = 4 THEN CASE WHEN k % 250 = 0 THEN '2001:db8::' ELSE '2001:db8::' || lower(hex(k % 250)) END ELSE concat('10.0.0.', k % 250) END END AS src, CASE WHEN reason IS NULL THEN CASE WHEN k % 9 = 4 THEN '::1' ELSE concat('192.168.1.', k % 7) END END AS dst,
    CASE WHEN reason IS NULL THEN proto END AS proto, CASE WHEN reason IS NULL AND proto <> 'icmp' THEN port END AS dst_port, CASE WHEN reason IS NULL AND proto = 'icmp' THEN 8 END AS icmp_type, CASE WHEN reason IS NULL AND k % 3 > 0 THEN concat('ifindex:', k % 3) END AS input_if,
    CASE WHEN reason IS NULL THEN (ts_us // 1000000) * 1000 - 10000 END AS end_ms, CASE WHEN reason IS NULL THEN (ts_us // 1000000) * 1000 - 40000 END AS start_ms, CASE WHEN k % 12 = 6 AND k % 21 <> 8 THEN 'duplicate,bytes_left_out' ELSE 'bytes_left_out' END AS notes FROM r""",
)
def v9_normal(spark, sf_dir):
    rows = netflow.v9_normal(netflow.v9_records(netflow.v9_parts(_v9(spark, sf_dir))))
    shown = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return rows.select("ordinal", F.coalesce("reason", F.lit("")).alias("reason"), *map(shown, ("src", "dst", "proto", "dst_port", "icmp_type", "input_if", "end_ms", "start_ms")), F.array_join("notes", ",").alias("notes"))


@query(
    "v9_audit",
    f"""WITH {_F} SELECT CASE WHEN k % 12 = 6 AND k % 2 = 1 THEN 'ambiguous_field' WHEN k % 16 = 5 THEN 'protocol' WHEN k % 9 = 4 AND k % 2 = 1 THEN 'address_family' WHEN k % 19 = 7 THEN 'time_order' ELSE 'taken' END AS action, count(*) AS n FROM f GROUP BY 1""",
)
def v9_audit(spark, sf_dir):
    """With bytes that are known to be those of IP, a record without packets has them as its counter."""
    return netflow.v9_audit(netflow.v9_normal(netflow.v9_records(netflow.v9_parts(_v9(spark, sf_dir))), ip_bytes=True))


_PARTS = ("'session-v1'", "'e' || (k % 5)", "src")


@query(
    "session_digests",
    f"WITH {_F} SELECT flow_id, sha256({' || '.join(f'unhex(lpad(hex(strlen({p})), 8, chr(48))) || encode({p})' for p in _PARTS)}) AS digest FROM f",
)
def session_digests(spark, sf_dir):
    return views.flows(spark, sf_dir).select("flow_id", ids.fingerprint(F.lit("session-v1"), F.concat(F.lit("e"), F.col("k") % 5), F.col("src")).alias("digest"))


@query(
    "exporter_states",
    f"""WITH {_F}, i AS (SELECT flow_id % 4 AS engine, row_number() OVER (PARTITION BY flow_id % 4 ORDER BY flow_id) - 1 AS i FROM f)
    SELECT CASE WHEN i = 0 THEN 'initial' WHEN i % 50 = 10 THEN 'duplicate' WHEN i % 50 IN (11, 21) THEN 'gap' ELSE 'in_order' END AS sequence_state,
           CASE WHEN i = 0 THEN 'initial' WHEN i % 50 = 20 THEN 'regressed' WHEN i % 50 = 30 THEN 'shifted' ELSE 'in_order' END AS clock_state, count(*) AS n, CAST(sum(CASE WHEN i % 50 IN (11, 21) THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM i GROUP BY ALL""",
)
def exporter_states(spark, sf_dir):
    """Exporters that now and then send a datagram twice, set their clock back for a moment or forward for good."""
    from pyspark.sql import Window

    i = F.col("i")
    rows = views.flows(spark, sf_dir).select("flow_id", (F.col("flow_id") % 4).alias("engine"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("engine").orderBy("flow_id")).cast("long") - 1)
    export = i + 10 * F.floor((i + 20) / 50) - F.when(i % 50 == 20, 5).otherwise(0) + 1_700_000_000
    heads = rows.select("engine", "flow_id", F.when(i % 50 == 10, i - 1).otherwise(i).alias("sequence"), F.lit(1).alias("count"), (i * 1000).alias("uptime_ms"), export.alias("export_s"), F.lit(0).alias("export_ns"))
    states = netflow.exporter_states(heads, ["engine"], "flow_id")
    return states.groupBy("sequence_state", "clock_state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"))
