"""Canonical observations from log lines: what must be there, which protocol it is, and why a row gives none."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taplight.functions import ids, times
from taplight.operators import enrich
from taplight.sources import shared, zeek
from taplight.sources.shared import computed_once

# Protocol numbers of the names that logs use, for each kind of log.
NAMED = {"conn": {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}, "dns": {"tcp": 6, "udp": 17}, "ssl": {"tcp": 6, "udp": 17}, "http": {"tcp": 6}}
KINDS = {"conn": "flow", "dns": "dns", "ssl": "tls", "http": "http"}


@dataclass(frozen=True)
class Origin:
    """Where observations come from; part of their identity."""

    sensor_id: str
    input_sha256: str
    observed_at: str
    namespace: uuid.UUID = ids.NAMESPACE
    marker: str = "record-id-v1"

    def __post_init__(self) -> None:
        if not self.sensor_id or len(self.input_sha256) != 64 or not set(self.input_sha256.lower()) <= set("0123456789abcdef"):
            raise ValueError("a sensor and the SHA-256 of its input are needed")


def _protocol(c: zeek._Cells, log: str) -> tuple[Column, Column]:
    """The protocol's number, that of the numeric cell before that of the name, and whether the two disagree."""
    number = c.number("ip_proto", "int")
    names = F.create_map(*(F.lit(x) for pair in NAMED[log].items() for x in pair))
    named = F.element_at(names, c.text("proto"))
    return F.coalesce(number, named), F.coalesce(number != named, F.lit(False))


def _first_of(tests: dict[str, Column]) -> Column:
    """The name of the first test that fails."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()))


def produce(lines: DataFrame, header: zeek.Header, log: str, origin: Origin, flows: DataFrame | None = None) -> DataFrame:
    """A row per log row: its observation, or the reason for which it gives none, and notes on what was odd.

    ``flows`` are the observations of the connections, best read from where they were written, for they are joined; rows of other logs are linked to the one flow that has their uid
    and ends (and, for handshakes and requests, both ports), and take its protocol where they have none.
    """
    cells = F.col("cells__")
    c = zeek._Cells(header, log, cells)
    number, conflict = _protocol(c, log)
    ports = {"src_port": c.number("id.orig_p", "int"), "dst_port": c.number("id.resp_p", "int")}
    base = {"uid": F.nullif(c.text("uid"), F.lit("")), "time_ns": times.nanoseconds(c.text("ts")), "src_ip": c.address("id.orig_h"), "dst_ip": c.address("id.resp_h"), **ports, "ip_protocol": number, "conflict": conflict}
    if log == "conn":
        counters = lambda side: F.struct(c.number(f"{side}_pkts", "decimal(20,0)").alias("packets"), c.number(f"{side}_bytes", "decimal(20,0)").alias("payload_bytes"), c.number(f"{side}_ip_bytes", "decimal(20,0)").alias("ip_bytes"))
        base |= {"length": c.text("duration"), "length_ns": times.nanoseconds(c.text("duration")), "forward": counters("orig"), "back": counters("resp"), "missed": c.number("missed_bytes", "decimal(20,0)"), **{f: F.nullif(c.text(f), F.lit("")) for f in ("service", "conn_state")}}
    elif log == "dns":
        base |= {"query": F.when(zeek.cell(header, "query", cells)["state"] == "empty", "").otherwise(c.text("query")), "qtype": c.number("qtype", "int"), "rcode": c.number("rcode", "int"), "answer_count": F.nullif(zeek.answer_count(header, "answers", cells), F.lit(-1))}
    else:
        own = ("version", "cipher", "server_name", "ja3", "ja3s", "ja4") if log == "ssl" else ("method", "host", "uri", "user_agent")
        base |= {f: F.nullif(c.text(f), F.lit("")) for f in own} | ({"status_code": c.number("status_code", "int")} if log == "http" else {})
    rows = computed_once(lines.withColumn("cells__", F.split("value", "\t")).select("ordinal", *(v.alias(n) for n, v in base.items())))
    own_fields = [n for n in base if n not in ("uid", "time_ns", "src_ip", "dst_ip", "src_port", "dst_port", "ip_protocol", "conflict")]
    rows = rows.withColumn("time", times.utc(F.col("time_ns")))
    if flows is None:
        rows = rows.withColumns({"link": F.lit(None).cast("string"), "outcome": F.lit(None).cast("string")})
    else:
        rows = _linked(shared.written(rows, "rows"), flows, log)
    required = {"time": F.col("time").isNull(), "src_ip": F.col("src_ip").isNull(), "dst_ip": F.col("dst_ip").isNull(), "protocol": F.col("ip_protocol").isNull()}
    if log == "conn":
        rows = rows.withColumn("end_time", times.utc(F.when(F.col("length_ns") >= 0, F.col("time_ns") + F.col("length_ns"))))
        none = lambda s: F.coalesce(s["packets"], s["payload_bytes"], s["ip_bytes"]).isNull()
        required["counters"] = none(F.col("forward"))
        portless = F.col("ip_protocol").isin(1, 58)
        data = {"start_time": F.col("time"), "end_time": F.col("end_time"), **{p: F.when(~portless, F.col(p)) for p in ports}, "service": F.col("service"), "connection_state": F.col("conn_state"), "src_to_dst": F.col("forward"), "dst_to_src": F.when(~none(F.col("back")), F.col("back"))}
        odd = {"duration": F.col("length").isNotNull() & F.col("end_time").isNull()}
    else:
        data = {"event_time": F.col("time"), "flow_record_id": F.col("link"), **{p: F.col(p) for p in ports}, **{f: F.col(f) for f in own_fields}}
        odd = {"ambiguous_flow": F.col("outcome") == "ambiguous", "inconsistent_flow": F.col("outcome") == "inconsistent"}
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in {"conflict": F.col("conflict"), **odd}.items())), lambda x: x.isNotNull())
    rows = computed_once(rows.withColumns({"reason": _first_of(required), "found": found}))
    reason, kind = F.col("reason"), KINDS[log]
    notes = F.when(reason.isNull(), F.col("found")).otherwise(F.array().cast("array<string>"))
    identity = ids.observation_id(origin.namespace, F.lit(origin.marker), F.lit(origin.sensor_id), F.lit(origin.input_sha256.lower()), F.lit(kind), F.lit(log), F.col("uid"), F.col("ordinal"))
    made = F.struct(F.col("src_ip"), F.col("dst_ip"), F.col("ip_protocol"), *(v.alias(n) for n, v in data.items()))
    lost = F.coalesce(F.col("missed") > 0, F.lit(False)) if log == "conn" else F.lit(False)
    return rows.select("ordinal", "reason", notes.alias("notes"), F.lit("1.0").alias("schema_version"), F.when(reason.isNull(), identity).alias("record_id"), F.col("uid").alias("source_record_id"), F.lit(kind).alias("observation_type"), F.lit(origin.sensor_id).alias("sensor_id"), F.lit(origin.observed_at).alias("observed_at"), lost.alias("loss_detected"), F.when(reason.isNull(), made).alias(kind))


def _linked(rows: DataFrame, flows: DataFrame, log: str) -> DataFrame:
    known = flows.where("reason is null").select(F.col("source_record_id").alias("uid"), *(F.col(f"flow.{c}").alias(n) for c, n in (("src_ip", "src"), ("dst_ip", "dst"), ("ip_protocol", "proto"), ("src_port", "sport"), ("dst_port", "dport"))), "record_id")
    ends = rows.select("ordinal", "uid", F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("ip_protocol").alias("proto"), F.col("src_port").alias("sport"), F.col("dst_port").alias("dport"))
    met = enrich.match_flows(ends, known, "ordinal", ports_may_lack=log == "dns", ports=("sport", "dport"), fill=log != "dns")
    out = rows.join(met.withColumnsRenamed({"record_id": "link"}), "ordinal", "left")
    return out if log == "dns" else out.withColumn("ip_protocol", F.col("proto")).drop("proto")


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """Observations of all kinds as one table, flows first, then names, handshakes and requests, each in order of its log."""
    out = None
    for place, (log, kind) in enumerate(KINDS.items()):
        if log in parts:
            one = parts[log].where("reason is null").withColumn("kind_rank", F.lit(place))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write(observations: DataFrame, path: str) -> None:
    """Observations as JSON lines below a new path; an existing one is an error, and Spark's commit leaves all or none."""
    observations.write.mode("errorifexists").json(path)
