"""Name, handshake and request logs with lines that Spark derives from the pages and events, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taplight.functions import measures
from taplight.operators import enrich
from taplight.plans.catalog import query
from taplight.plans.text_queries import _ENTROPY
from taplight.sources.shared import computed_once
from taplight.sources import features, views, zeek
from taplight.sources.views import FLOWS_SQL

_ENDS = ("ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto")
DNS = zeek.Header((*_ENDS, "query", "qtype", "qtype_name", "rcode", "AA", "RD", "Z", "answers", "rejected"))
SSL = zeek.Header((*_ENDS, "version", "cipher", "server_name", "ja3", "ja3s", "ja4"))
HTTP = zeek.Header((*_ENDS, "method", "host", "uri", "user_agent", "request_body_len", "response_body_len", "status_code"))

#: Names and addresses of pages in both dialects.
_HOST, _PATH = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))", "regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1)"
_P = f"p AS (SELECT page_id, page_id AS i, {_HOST} AS host, {_PATH} AS path FROM pages)"


def _pages(spark, sf_dir) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("i"), F.expr(_HOST).alias("host"), F.expr(_PATH).alias("path"))


def _lines(spark, sf_dir, cells: list[str]) -> DataFrame:
    ends = ["concat(CAST(i AS STRING), '.25')", "concat('C', CAST(i % 50 AS STRING))", "CASE WHEN i % 19 = 0 THEN '999.1.1.1' WHEN i % 19 = 1 THEN 'fe80::1' ELSE concat('10.0.1.', CAST(i % 7 AS STRING)) END", "CASE WHEN i % 23 = 0 THEN '65536' ELSE CAST(1024 + i % 1000 AS STRING) END", "concat('10.9.9.', CAST(i % 2 AS STRING))", "'53'", "CASE WHEN i % 5 = 0 THEN '-' ELSE 'udp' END"]
    return _pages(spark, sf_dir).select(F.col("i").alias("ordinal"), F.concat_ws("\t", *map(F.expr, [*ends, *cells])).alias("value"))


_SRC = "CASE WHEN i % 19 = 0 THEN NULL WHEN i % 19 = 1 THEN 'fe80::1' ELSE concat('10.0.1.', i % 7) END"
_PORT = "CASE WHEN i % 23 <> 0 THEN CAST(1024 + i % 1000 AS INT) END"


def _dns_lines(spark, sf_dir):
    return _lines(spark, sf_dir, ["CASE WHEN i % 11 = 0 THEN '(empty)' ELSE host END", "CASE WHEN i % 4 = 0 THEN 'x' ELSE CAST(i % 30 AS STRING) END", "CASE WHEN i % 3 = 0 THEN 'txt' ELSE '-' END", "CASE WHEN i % 6 = 0 THEN '-' ELSE CAST(i % 12 AS STRING) END", "CASE WHEN i % 7 = 0 THEN 'X' WHEN i % 2 = 0 THEN 'T' ELSE 'F' END", "'T'", "CAST(i % 300 AS STRING)", "CASE i % 5 WHEN 0 THEN '-' WHEN 1 THEN '(empty)' WHEN 2 THEN 'a,,b' WHEN 3 THEN 'a' ELSE 'a,b,c' END", "'F'"])


@query(
    "dns_rows",
    f"""WITH {_P} SELECT i AS source_ordinal, concat('C', i % 50) AS uid, i + 0.25::DOUBLE AS event_time, CASE WHEN i % 11 = 0 THEN '' ELSE host END AS query, CASE WHEN i % 4 = 0 THEN '' ELSE cast(i % 30 AS VARCHAR) END AS qtype, CASE WHEN i % 3 = 0 THEN 'txt' END AS qtype_name,
    CASE WHEN i % 6 = 0 THEN '' ELSE cast(i % 12 AS VARCHAR) END AS rcode, {_SRC} AS src_ip, {_PORT} AS src_port, CASE WHEN i % 5 <> 0 THEN 'udp' END AS proto, CASE WHEN i % 7 <> 0 THEN i % 2 = 0 END AS authoritative_answer, CASE WHEN i % 300 < 256 THEN CAST(i % 300 AS INT) END AS z,
    CASE i % 5 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 3 END AS answer_count, FALSE AS rejected FROM p""",
)
def dns_rows(spark, sf_dir):
    rows = zeek.protocol_rows(_dns_lines(spark, sf_dir), DNS, "dns")
    return rows.select("source_ordinal", "uid", "event_time", "query", "qtype", "qtype_name", "rcode", "src_ip", "src_port", "proto", "authoritative_answer", "z", "answer_count", "rejected")


@query(
    "dns_diagnostics",
    f"""WITH {_P}, d AS (SELECT unnest([CASE WHEN i % 19 = 0 THEN 'bad_address id.orig_h' END, CASE WHEN i % 23 = 0 THEN 'bad_integer id.orig_p' END, CASE WHEN i % 4 = 0 THEN 'bad_integer qtype' END, CASE WHEN i % 7 = 0 THEN 'bad_boolean AA' END, CASE WHEN i % 300 > 255 THEN 'bad_integer Z' END, CASE WHEN i % 5 = 2 THEN 'bad_set answers' END]) AS note FROM p)
    SELECT split_part(note, ' ', 1) AS kind, split_part(note, ' ', 2) AS field, count(*) AS n FROM d WHERE note IS NOT NULL GROUP BY ALL""",
)
def dns_diagnostics(spark, sf_dir):
    return zeek.lossless(_dns_lines(spark, sf_dir), DNS, "dns")[1].groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


def _ssl_lines(spark, sf_dir):
    return _lines(spark, sf_dir, ["CASE i % 4 WHEN 0 THEN 'TLSv12' WHEN 1 THEN 'TLSv13' WHEN 2 THEN 'SSLv3' ELSE '-' END", "CASE WHEN i % 9 = 0 THEN '-' ELSE concat('TLS_', repeat('A', CAST(i % 20 AS INT))) END", "CASE WHEN i % 3 = 0 THEN '-' ELSE host END", "CASE WHEN i % 2 = 0 THEN md5(host) ELSE '-' END", "'-'", "CASE WHEN i % 5 = 0 THEN 't13d' ELSE '(empty)' END"])


@query(
    "ssl_rows",
    f"""WITH {_P} SELECT i AS source_ordinal, {_SRC} AS src_ip, {_PORT} AS src_port, CASE i % 4 WHEN 0 THEN 'TLSv12' WHEN 1 THEN 'TLSv13' WHEN 2 THEN 'SSLv3' ELSE '' END AS version, CASE WHEN i % 3 = 0 THEN '' ELSE host END AS server_name, CASE WHEN i % 2 = 0 THEN md5(host) END AS ja3, CAST(NULL AS VARCHAR) AS ja3s, CASE WHEN i % 5 = 0 THEN 't13d' END AS ja4 FROM p""",
)
def ssl_rows(spark, sf_dir):
    return zeek.protocol_rows(_ssl_lines(spark, sf_dir), SSL, "ssl").select("source_ordinal", "src_ip", "src_port", "version", "server_name", "ja3", "ja3s", "ja4")


def _http_lines(spark, sf_dir):
    return _lines(spark, sf_dir, ["CASE i % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' WHEN 2 THEN 'BREW' ELSE '-' END", "host", "CASE WHEN path = '' THEN '(empty)' ELSE path END", "CASE WHEN i % 3 = 0 THEN '-' ELSE 'agent/1.0' END", "CASE WHEN i % 8 = 0 THEN '-1' ELSE CAST(i AS STRING) END", "'-'", "CASE WHEN i % 6 = 0 THEN '70000' ELSE '200' END"])


_HTTP_SQL = f"h AS (SELECT i, host, CASE i % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' WHEN 2 THEN 'BREW' ELSE '' END AS method, path AS uri, CASE WHEN i % 3 = 0 THEN '' ELSE 'agent/1.0' END AS user_agent, CASE WHEN i % 8 = 0 THEN 0 ELSE i END AS request_body_len, CASE WHEN i % 6 = 0 THEN 0 ELSE 200 END AS status_code FROM p)"


@query(
    "http_rows",
    f"WITH {_P}, {_HTTP_SQL} SELECT i AS source_ordinal, {_SRC} AS src_ip, {_PORT} AS src_port, method, host, uri, user_agent, request_body_len, CAST(0 AS BIGINT) AS response_body_len, status_code FROM h",
)
def http_rows(spark, sf_dir):
    return zeek.protocol_rows(_http_lines(spark, sf_dir), HTTP, "http").select("source_ordinal", "src_ip", "src_port", "method", "host", "uri", "user_agent", "request_body_len", "response_body_len", "status_code")


@query(
    "flow_features",
    f"""WITH f AS ({FLOWS_SQL}) SELECT concat(src, ':', dst, ':', port, ':', proto, ':', printf('%.3f', ts_us / 1000000.0)) AS flow_id, round(resp_bytes / (coalesce(orig_bytes, 0) + 1.0), 9) AS byte_ratio, round(3 / (orig_pkts + 1.0), 9) AS pkt_ratio,
    CASE state WHEN 'S1' THEN 1 WHEN 'S2' THEN 2 WHEN 'S3' THEN 3 WHEN 'SF' THEN 4 WHEN 'REJ' THEN 5 WHEN 'RSTOS0' THEN 7 WHEN 'RSTR' THEN 8 WHEN 'OTH' THEN 12 ELSE 0 END AS conn_state_encoded FROM f""",
)
def flow_features(spark, sf_dir):
    conn = views.flows(spark, sf_dir).select("src", "dst", F.col("port").alias("dst_port"), "proto", (F.col("ts_us") / 1e6).alias("ts"), F.coalesce("orig_bytes", F.lit(0)).alias("orig_bytes"), "resp_bytes", "orig_pkts", F.lit(3).alias("resp_pkts"), F.coalesce("state", F.lit("")).alias("conn_state"))
    return measures.flow_features(conn).select("flow_id", F.round("byte_ratio", 9).alias("byte_ratio"), F.round("pkt_ratio", 9).alias("pkt_ratio"), "conn_state_encoded")


@query(
    "tls_features",
    f"""WITH {_P} SELECT i AS source_ordinal, i % 2 = 0 AS has_ja3, FALSE AS has_ja3s, CASE i % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 0 END AS ssl_version_encoded, CASE WHEN i % 9 = 0 THEN 0 ELSE CAST((4 + i % 20) % 16 + 1 AS INT) END AS cipher_encoded,
    CASE WHEN i % 3 <> 0 AND host <> '' THEN length(host)::INT END AS sni_length, CASE WHEN i % 3 <> 0 AND host <> '' THEN round({_ENTROPY.format('host')}, 6) END AS sni_entropy FROM p""",
)
def tls_features(spark, sf_dir):
    rows = measures.tls_block(zeek.protocol_rows(_ssl_lines(spark, sf_dir), SSL, "ssl"))
    return rows.select("source_ordinal", "has_ja3", "has_ja3s", "ssl_version_encoded", "cipher_encoded", "block.sni_length", F.round("block.sni_entropy", 6).alias("sni_entropy"))


@query(
    "http_features",
    f"""WITH {_P}, {_HTTP_SQL} SELECT i AS source_ordinal, CASE upper(method) WHEN 'GET' THEN 1 WHEN 'POST' THEN 2 ELSE 0 END AS method_encoded, length(host)::INT AS host_length, length(uri)::INT AS uri_length, round({_ENTROPY.format('uri')}, 6) AS uri_entropy, user_agent <> '' AS has_user_agent, length(user_agent)::INT AS user_agent_length, nullif(method, '') AS method FROM h""",
)
def http_features(spark, sf_dir):
    rows = measures.http_block(zeek.protocol_rows(_http_lines(spark, sf_dir), HTTP, "http"))
    return rows.select("source_ordinal", "method_encoded", "host_length", "uri_length", F.round("uri_entropy", 6).alias("uri_entropy"), "has_user_agent", "user_agent_length", "block.method")


@query(
    "dns_features",
    f"""WITH {_P}, d AS (SELECT i, CASE WHEN i % 11 = 0 THEN '' ELSE host END AS q FROM p)
    SELECT i AS source_ordinal, length(q)::INT AS query_length, round({_ENTROPY.format('q')}, 6) AS query_entropy, len(string_split(q, '.'))::INT AS label_count, coalesce(CASE WHEN i % 3 = 0 THEN 'TXT' WHEN i % 4 <> 0 THEN CASE i % 30 WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 6 THEN 'SOA' WHEN 12 THEN 'PTR' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' ELSE cast(i % 30 AS VARCHAR) END END, 'none') AS qtype,
    CASE WHEN i % 6 <> 0 THEN CASE i % 12 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN 'REFUSED' WHEN 6 THEN 'YXDOMAIN' WHEN 7 THEN 'YXRRSET' WHEN 8 THEN 'NXRRSET' WHEN 9 THEN 'NOTAUTH' WHEN 10 THEN 'NOTZONE' ELSE '11' END END AS rcode, nullif(q, '') AS query FROM d""",
)
def dns_features(spark, sf_dir):
    rows = measures.dns_block(zeek.protocol_rows(_dns_lines(spark, sf_dir), DNS, "dns"))
    return rows.select("source_ordinal", "query_length", F.round("query_entropy", 6).alias("query_entropy"), "label_count", F.coalesce("block.qtype", F.lit("none")).alias("qtype"), "block.rcode", "block.query")


def _flows_of(spark, sf_dir, kind: str, blocks: DataFrame) -> DataFrame:
    """Flows with a protocol's block and array, joined by identifier; flows whose number divides by 4 have no array."""
    conn = views.flows(spark, sf_dir).select(F.concat(F.lit("C"), F.col("flow_id") % 70).alias("uid"), F.col("flow_id").alias("ordinal"), (F.col("ts_us") / 1e6).alias("event_time"), F.col("src").alias("src_ip"), F.lit(9).alias("src_port"), F.col("dst").alias("dst_ip"), F.col("port").alias("dst_port"), "proto", F.coalesce("orig_bytes", F.lit(7)).alias("orig_bytes"))
    rows = blocks.select("uid", (F.col("event_time") * 1e6).cast("long").alias("ts_us"), F.col("source_ordinal").alias("ordinal"), "block")
    joined = enrich.join_first(conn, rows, "first")
    array = F.transform(f"first_transactions", lambda t: t["block"])
    return joined.select(*conn.columns, F.col("first.block").alias(kind), F.when(F.col("ordinal") % 4 != 0, array).alias(f"{kind}_transactions"))


@query(
    "dns_transactions",
    f"""WITH {_P}, f AS ({FLOWS_SQL}), c AS (SELECT concat('C', flow_id % 70) AS uid, min(flow_id) AS ordinal FROM f GROUP BY 1), u AS (SELECT c.uid, c.ordinal, f.ts_us, f.src, coalesce(f.orig_bytes, 7) AS orig_bytes FROM c JOIN f ON f.flow_id = c.ordinal),
    d AS (SELECT i, concat('C', i % 50) AS uid, CASE WHEN i % 11 = 0 THEN NULL ELSE nullif(host, '') END AS query, {_SRC} AS src, row_number() OVER (PARTITION BY i % 50 ORDER BY i) AS rn FROM p)
    SELECT u.ordinal, CASE WHEN u.ordinal % 4 = 0 THEN round(u.ts_us / 1000000.0, 6) ELSE d.i + 0.25 END AS event_time, d.query, CASE WHEN u.ordinal % 4 = 0 THEN u.src ELSE coalesce(d.src, u.src) END AS src_ip, CASE WHEN u.ordinal % 4 = 0 OR d.rn = 1 THEN u.orig_bytes ELSE 0 END AS orig_bytes FROM u JOIN d ON u.uid = d.uid WHERE u.ordinal % 4 <> 0 OR d.rn = 1""",
)
def dns_transactions(spark, sf_dir):
    flows = _flows_of(spark, sf_dir, "dns", measures.dns_block(zeek.protocol_rows(_dns_lines(spark, sf_dir), DNS, "dns")))
    return measures.per_transaction(flows, "dns").select("ordinal", F.round("event_time", 6).alias("event_time"), "dns.query", "src_ip", "orig_bytes")


@query(
    "server_names",
    f"""WITH {_P}, s AS (SELECT i, CASE i % 3 WHEN 0 THEN ' ' || host || ' ' WHEN 1 THEN '  ' END AS server_name, trim(host) AS name FROM p)
    SELECT i, CASE WHEN i % 3 = 0 AND name <> '' THEN length(name)::INT ELSE 7 END AS sni_length, CASE WHEN i % 3 = 0 AND name <> '' THEN round({_ENTROPY.format('name')}, 6) ELSE 1.5 END AS sni_entropy FROM s""",
)
def server_names(spark, sf_dir):
    tls = F.struct(F.when(F.col("i") % 3 == 0, F.concat(F.lit(" "), "host", F.lit(" "))).when(F.col("i") % 3 == 1, "  ").alias("server_name"), F.lit(7).alias("sni_length"), F.lit(1.5).alias("sni_entropy"))
    length, entropy = measures.server_name_measures(F.col("tls"))
    return _pages(spark, sf_dir).select("i", tls.alias("tls")).select("i", length.alias("sni_length"), F.round(entropy, 6).alias("sni_entropy"))


def _record_lines(spark, sf_dir):
    """Feature records with blocks and arrays of all three protocols, some of them broken in one way each."""
    k = F.col("k") % 24
    block = lambda n, uid="u": F.struct(F.lit(uid).alias("uid"), n.alias("transaction_count"))
    one = lambda uid, at: F.struct(F.lit(uid).alias("uid"), F.lit(at).alias("source_ordinal"))
    arrays = F.when(k == 3, F.array(one("u", 1))).when(k == 4, F.array(one("u", 1), one("v", 2))).when(k == 5, F.array(one("u", 2), one("u", 2))).otherwise(F.array(one("u", 1), one("u", 5)))
    made = lambda name: {name: F.when(k != 7, block(F.when(k != 6, F.lit(2)))), f"{name}_transactions": F.when(k != 8, arrays)}
    kind = F.expr("element_at(array('dns', 'tls', 'http'), CAST(k div 24 % 3 + 1 AS INT))")
    fields = {}
    for name in ("dns", "tls", "http"):
        fields |= {n: F.when(kind == name, c) for n, c in made(name).items()}
    core = {"flow_id": F.lit("f:1.5"), "src_ip": F.col("src"), "dst_ip": F.col("dst"), "proto": F.col("proto"), **{c: F.lit(1) for c in ("duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")}, "conn_state_encoded": (F.col("k") % 13).cast("int")}
    value = F.to_json(F.struct(*(c.alias(n) for n, c in {**core, **fields}.items())))
    broken = F.when(k == 9, F.regexp_replace(value, '"(dns|tls|http)":\\{[^}]*\\}', '"$1":"text"')).otherwise(value)
    return computed_once(views.flows(spark, sf_dir).select("flow_id", kind.alias("block"), broken.alias("value")))


@query(
    "transaction_rejects",
    f"""WITH f AS ({FLOWS_SQL}), t AS (SELECT ['dns', 'tls', 'http'][1 + (k // 24) % 3] AS kind, k % 24 AS m FROM f), r AS (SELECT kind, CASE WHEN kind = 'dns' THEN '' ELSE kind || '_' END AS pre, m FROM t)
    SELECT kind AS block, CASE m WHEN 3 THEN pre || 'transactions' WHEN 4 THEN pre || 'transaction_uids' WHEN 5 THEN pre || 'transaction_order' WHEN 6 THEN pre || 'transactions' WHEN 7 THEN pre || 'transactions' WHEN 9 THEN 'type_' || kind || ',' || pre || 'transactions' ELSE '' END AS reasons, count(*) AS n FROM r GROUP BY ALL""",
)
def transaction_rejects(spark, sf_dir):
    parsed = features.parse(_record_lines(spark, sf_dir))
    return parsed.groupBy("block", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "decoded_records",
    f"""WITH f AS ({FLOWS_SQL}) SELECT flow_id, CASE k % 13 WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'S3' WHEN 4 THEN 'SF' WHEN 5 THEN 'REJ' WHEN 6 THEN 'RSTO' WHEN 7 THEN 'RSTOS0' WHEN 8 THEN 'RSTR' WHEN 9 THEN 'RSTRH' WHEN 10 THEN 'SH' WHEN 11 THEN 'SHR' WHEN 12 THEN 'OTH' END AS conn_state FROM f WHERE k % 24 NOT IN (3, 4, 5, 6, 7, 9)""",
)
def decoded_records(spark, sf_dir):
    good = computed_once(features.parse(_record_lines(spark, sf_dir))).where(F.size("reasons") == 0).select(F.col("flow_id").alias("id"), "record.*")
    return features.decoded(good).select(F.col("id").alias("flow_id"), "conn_state")
