"""Canonical observations as JSON lines: fixed checks, exact times, and the mapping to flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taplight.sources.shared import computed_once

COUNTERS = "struct<packets:decimal(20,0),payload_bytes:decimal(20,0),ip_bytes:decimal(20,0),l2_bytes:decimal(20,0)>"
FLOW = f"struct<start_time:string,end_time:string,src_ip:string,dst_ip:string,src_port:int,dst_port:int,ip_protocol:int,connection_state:string,counters:struct<src_to_dst:{COUNTERS},dst_to_src:{COUNTERS}>>"
SCHEMA = f"schema_version string, record_id string, observation_type string, telemetry_source string, sensor_id string, observed_at string, data {FLOW}"
_TIME = r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3}|\.\d{6}|\.\d{9})?Z\z"
MOST_BYTES = 65_536


def nanoseconds(time: Column) -> Column:
    """Exact nanoseconds since the epoch of a UTC time in the strict layout; null for any other text or calendar day."""
    seconds = F.concat(F.substring(time, 1, 19), F.lit("Z")).try_cast("timestamp")
    fraction = F.rpad(F.substring(time, F.lit(21), F.char_length(time) - 21), 9, "0").try_cast("decimal(20,0)")
    return F.when(time.rlike(_TIME), F.unix_seconds(seconds).cast("decimal(20,0)") * 1_000_000_000 + fraction)


def parse(lines: DataFrame) -> DataFrame:
    """``value`` lines as records with the reasons for which each is unfit; a run that must be whole stops if any has one."""
    read = computed_once(lines.withColumn("record", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})))
    r, d = F.col("record"), F.col("record")["data"]
    rows = computed_once(read.withColumns({"start_ns": nanoseconds(d["start_time"]), "end_ns": nanoseconds(d["end_time"])}))
    start, end = F.col("start_ns"), F.col("end_ns")
    forward = d["counters"]["src_to_dst"]
    tests = {
        "size": F.octet_length("value") > MOST_BYTES,
        "json": F.try_parse_json("value").isNull(),
        "version": F.coalesce(r["schema_version"] != "1.0", F.lit(True)),
        "record_id": F.coalesce(r["record_id"] == "", F.lit(True)),
        "type": ~F.coalesce(r["observation_type"].isin("flow", "dns", "tls", "http"), F.lit(False)),
        "observed_at": nanoseconds(r["observed_at"]).isNull(),
        "times": (r["observation_type"] == "flow") & (start.isNull() | end.isNull()),
        "order": end < start,
        "port": (d["dst_port"] < 0) | (d["dst_port"] > 65535) | (d["src_port"] < 0) | (d["src_port"] > 65535),
        "counters": (r["observation_type"] == "flow") & forward["packets"].isNull() & forward["ip_bytes"].isNull() & forward["payload_bytes"].isNull(),
        "negative": (forward["packets"] < 0) | (forward["ip_bytes"] < 0),
    }
    reasons = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items())), lambda x: x.isNotNull())
    return computed_once(rows.withColumn("reasons", reasons))


def to_flows(parsed: DataFrame, names: dict[int, str]) -> DataFrame:
    """Flow records without reasons as flows; IP bytes and payload bytes stay apart, a duration is exact."""
    from taplight.functions import codes

    d = F.col("record")["data"]
    protocol = F.coalesce(codes.lookup(names, d["ip_protocol"]), F.concat(F.lit("ip_protocol_"), d["ip_protocol"].cast("string")))
    good = parsed.where((F.size("reasons") == 0) & (F.col("record")["observation_type"] == "flow"))
    forward = d["counters"]["src_to_dst"]
    return good.select(F.col("record")["record_id"].alias("flow_id"), (F.col("end_ns") - F.col("start_ns")).cast("long").alias("duration_ns"), d["src_ip"].alias("src"), d["dst_ip"].alias("dst"), d["dst_port"].alias("port"), protocol.alias("proto"), forward["packets"].cast("long").alias("orig_pkts"), forward["ip_bytes"].cast("long").alias("orig_ip_bytes"), forward["payload_bytes"].cast("long").alias("orig_bytes"))
