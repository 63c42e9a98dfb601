"""What is derived from connection, name, handshake and request rows, and the blocks that carry it with a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taplight.functions import codes, text


def _clean(c: Column) -> Column:
    """A text without its unset markers."""
    return F.when(~F.trim(c).isin(*codes.UNSET_CELLS), c)


def flow_features(conn: DataFrame) -> DataFrame:
    """Legacy connection rows as flows: an identifier from ends and time, ratios of what came back, the state's code."""
    key = F.concat_ws(":", "src", "dst", F.col("dst_port").cast("string"), "proto", text.three_decimals(F.col("ts").cast("double")))
    back = lambda a, b: F.col(a).cast("double") / (F.col(b).cast("double") + 1.0)
    return conn.withColumns({"flow_id": key, "byte_ratio": back("resp_bytes", "orig_bytes"), "pkt_ratio": back("resp_pkts", "orig_pkts"), "conn_state_encoded": codes.code_of(codes.CONN_STATES, F.col("conn_state"))})


def dns_features(rows: DataFrame) -> DataFrame:
    """Measures of ``query`` and whether ``qtype`` asks for text."""
    q = F.col("query")
    return rows.withColumns({"query_length": F.char_length(q), "query_entropy": text.entropy(q), "subdomain_entropy": text.subdomain_entropy(q), "is_txt": F.upper("qtype") == "TXT", "label_count": text.label_count(q)})


def tls_features(rows: DataFrame) -> DataFrame:
    """Which fingerprints there are, the version's code, and a bucket of the cipher's name by its size in bytes."""
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    size = F.octet_length("cipher")
    return rows.withColumns({"has_ja3": there("ja3"), "has_ja3s": there("ja3s"), "ssl_version_encoded": codes.code_of(codes.TLS_VERSIONS, F.col("version")), "cipher_encoded": F.when(size > 0, size % 16 + 1).otherwise(0)})


def http_features(rows: DataFrame) -> DataFrame:
    """The method's code, sizes of host, address and agent, and the address's entropy."""
    agent = F.char_length("user_agent")
    return rows.withColumns({"method_encoded": codes.code_of(codes.HTTP_METHODS, F.upper("method")), "host_length": F.char_length("host"), "uri_length": F.char_length("uri"), "uri_entropy": text.entropy(F.col("uri")), "has_user_agent": agent > 0, "user_agent_length": agent})


_SOURCE = ("event_time", "source_ordinal", "src_ip", "src_port", "dst_ip", "dst_port", "proto")


def _block(fields: dict[str, Column], more: tuple[str, ...] = ()) -> Column:
    ends = {c: _clean(F.col(c)) if c in ("src_ip", "dst_ip", "proto") else F.col(c) for c in _SOURCE}
    return F.struct(*(c.alias(n) for n, c in {**fields, **ends, **{c: F.col(c) for c in more}}.items()))


def dns_block(rows: DataFrame) -> DataFrame:
    """Detector rows of names, with ``block``: names of codes before codes, names without unset markers."""
    qtype = codes.name_of_code(F.coalesce(F.nullif("qtype_name", F.lit("")), F.col("qtype")), codes.QTYPES)
    rcode = codes.name_of_code(F.coalesce(F.nullif("rcode_name", F.lit("")), F.col("rcode")), codes.RCODES)
    made = dns_features(rows)
    fields = {"uid": F.col("uid"), "query": _clean(F.col("query")), "qtype": qtype, "qtype_num": _clean(F.col("qtype")), "rcode": rcode, "rcode_num": _clean(F.col("rcode")), **{c: F.col(c) for c in ("query_length", "query_entropy", "subdomain_entropy", "label_count")}, "is_txt": F.coalesce(qtype == "TXT", F.lit(False))}
    return made.withColumn("block", _block(fields, ("authoritative_answer", "truncated", "recursion_desired", "recursion_available", "z", "answer_count", "rejected")))


def tls_block(rows: DataFrame) -> DataFrame:
    """Detector rows of handshakes, with ``block``; the server name is measured where there is one."""
    made, name = tls_features(rows), _clean(F.col("server_name"))
    fields = {"uid": F.col("uid"), **{c: _clean(F.col(c)) for c in ("ja3", "ja3s", "ja4")}, "server_name": name, "version": _clean(F.col("version")), "cipher": _clean(F.col("cipher")), **{c: F.col(c) for c in ("has_ja3", "has_ja3s", "ssl_version_encoded")}, "sni_length": F.char_length(name), "sni_entropy": text.entropy(name)}
    return made.withColumn("block", _block(fields))


def http_block(rows: DataFrame) -> DataFrame:
    """Detector rows of requests, with ``block``."""
    made = http_features(rows)
    fields = {"uid": F.col("uid"), **{c: _clean(F.col(c)) for c in ("host", "uri", "user_agent", "method")}, **{c: F.col(c) for c in ("status_code", "host_length", "uri_length", "uri_entropy", "has_user_agent", "user_agent_length", "request_body_len", "response_body_len")}}
    return made.withColumn("block", _block(fields))


def server_name_measures(tls: Column) -> tuple[Column, Column]:
    """Length and entropy of a block's server name; where it has no name, what the block says of them."""
    name = F.trim(tls["server_name"])
    there = F.coalesce(name != "", F.lit(False))
    return F.when(there, F.char_length(name)).otherwise(tls["sni_length"]), F.when(there, text.entropy(name)).otherwise(tls["sni_entropy"])


def per_transaction(flows: DataFrame, kind: str) -> DataFrame:
    """A row per transaction of a protocol, or the flow's own block where it has no array; flows without either go.

    Time and ends are the transaction's where it has them; bytes that a flow sent are charged to its first transaction.
    """
    array = F.col(f"{kind}_transactions")
    several = F.coalesce(F.size(array), F.lit(0)) > 0
    tall = flows.select("*", F.posexplode_outer(F.when(several, array)).alias("position", "one"))
    block = F.col(kind)
    one = lambda f: F.when(several, F.coalesce(F.col("one")[f], F.col(f))).otherwise(F.col(f))
    names = [f.name for f in flows.schema[kind].dataType.fields]
    held = {f.name for f in flows.schema[f"{kind}_transactions"].dataType.elementType.fields}
    shared = F.struct(*(F.when(several, F.col("one")[n]).otherwise(block[n]).alias(n) if n in held else F.when(~several, block[n]).alias(n) for n in names))
    ends = {f: one(f) for f in ("event_time", "src_ip", "src_port", "dst_ip", "dst_port", "proto") if f in held and f in flows.columns}
    sent = {"orig_bytes": F.when(several & (F.col("position") > 0), F.lit(0)).otherwise(F.col("orig_bytes"))} if kind == "dns" and "orig_bytes" in flows.columns else {}
    return tall.where(several | block.isNotNull()).withColumns({**ends, **sent, kind: shared}).drop("one", f"{kind}_transactions")
