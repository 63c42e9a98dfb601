"""Tab-separated connection and protocol logs with a header."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taplight.sources.shared import computed_once


@dataclass(frozen=True)
class Header:
    """Field places and cell markers."""

    fields: tuple[str, ...]
    set_separator: str = ","
    empty: str = "(empty)"
    unset: str = "-"


def parse_header(lines: list[str]) -> Header:
    """From the lines that begin with ``#``; without ``#fields`` the log can't be read."""
    found = {}
    for line in lines:
        name, _, rest = line.partition("\t")
        found[name] = rest
    if "#fields" not in found:
        raise ValueError("the log has no #fields line")
    return Header(tuple(found["#fields"].split("\t")), found.get("#set_separator", ","), found.get("#empty_field", "(empty)"), found.get("#unset_field", "-"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, value): lines that are data, numbered from 0 in the order of each file.

    Files are read in splits.  Lines are numbered within their split, whose place in the file Spark tells; the splits
    before it are counted, so no file goes through one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    data = raw.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = data.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy("place")) - 1
    return data.withColumn("within", within).join(offsets, ["file", "split"]).select("file", (F.col("offset") + F.col("within")).alias("ordinal"), "value")


def read_header(spark: SparkSession, path: str) -> Header:
    """The header that all files of a path have; files that differ in it are an error, for their columns differ."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^#(fields|set_separator|empty_field|unset_field)\t")).distinct().collect()
    lines = [r["value"] for r in rows]
    if len({line.split("\t", 1)[0] for line in lines}) < len(lines):
        raise ValueError("the files' headers differ")
    return parse_header(lines)


def cell(header: Header, name: str, cols: Column | None = None) -> Column:
    """(state, value) of a named cell: missing, unset, empty or value."""
    cols = F.split("value", "\t") if cols is None else cols
    if name not in header.fields:
        return F.struct(F.lit("missing").alias("state"), F.lit(None).cast("string").alias("value"))
    raw = F.get(cols, F.lit(header.fields.index(name)))
    state = F.when(raw.isNull(), "missing").when(raw == header.unset, "unset").when(raw == header.empty, "empty").otherwise("value")
    return F.struct(state.alias("state"), F.when(state == "value", raw).alias("value"))


def answer_count(header: Header, name: str, cols: Column | None = None) -> Column:
    """How many elements a set cell has; null where it is absent, -1 where an element or the separator is empty."""
    c = cell(header, name, cols)
    if not header.set_separator:
        return F.when(c["state"] == "value", F.lit(-1)).when(c["state"] == "empty", F.lit(0))
    parts = F.split(c["value"], f"\\Q{header.set_separator}\\E")
    some = F.when(F.exists(parts, lambda p: p == "") | (F.size(parts) > 65535), F.lit(-1)).otherwise(F.size(parts))
    return F.when(c["state"] == "empty", F.lit(0)).when((c["state"] == "value") & (c["value"] == ""), F.lit(0)).when(c["state"] == "value", some)


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
#: Texts of addresses: eight groups, or fewer with one run of zeros left out, the last two perhaps as IPv4.
_V6 = "|".join([f"({_H}:){{7}}{_H}", f"({_H}:){{6}}{_V4}", *(f"({_H}:){{{a}}}(:{_H}){{1,{7 - a}}}" if a else f":(:{_H}){{1,7}}" for a in range(7)), f"({_H}:){{1,7}}:", "::", *(f"({_H}:){{{a}}}(:{_H}){{0,{5 - a}}}:{_V4}" if a else f":(:{_H}){{0,5}}:{_V4}" for a in range(6))])
_ADDRESS = f"^({_V4}|{_V6})$"

#: Types of the named columns of each log; columns without a type are texts.
_ENDS = {"ts": "decimal", "id.orig_h": "address", "id.resp_h": "address", "id.orig_p": "u16", "id.resp_p": "u16", "ip_proto": "u8"}
TYPES = {
    "conn": _ENDS | {"duration": "length"} | dict.fromkeys(("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes", "missed_bytes"), "u64"),
    "dns": _ENDS | {"trans_id": "u16", "rtt": "length", "qclass": "u16", "qtype": "u16", "rcode": "u16", "Z": "u8", "answers": "set"} | dict.fromkeys(("AA", "TC", "RD", "RA", "rejected"), "bool"),
    "ssl": _ENDS | dict.fromkeys(("resumed", "established"), "bool"),
    "http": _ENDS | {"trans_depth": "u64", "request_body_len": "u64", "response_body_len": "u64", "status_code": "u16"},
}
_MOST = {"u8": 255, "u16": 65535, "u64": (1 << 64) - 1}
_BAD = {"decimal": "bad_decimal", "length": "bad_decimal", "address": "bad_address", "bool": "bad_boolean", "u8": "bad_integer", "u16": "bad_integer", "u64": "bad_integer"}


def readable(value: Column, kind: str) -> Column:
    """Whether a cell's text is of its type; a length is a decimal that is not below zero."""
    if kind == "decimal":
        return value.rlike(r"^[+-]?\d+(\.\d+)?$")
    if kind == "length":
        return value.rlike(r"^\+?\d+(\.\d+)?$")
    if kind == "address":
        return value.rlike(_ADDRESS)
    if kind == "bool":
        return value.isin("T", "F")
    if kind in _MOST:
        return value.rlike(r"^\d+$") & F.coalesce(value.try_cast("decimal(38,0)") <= F.lit(Decimal(_MOST[kind])), F.lit(False))
    return F.lit(True)


def lossless(lines: DataFrame, header: Header, log: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its cells, and the diagnostics: nothing is dropped for a cell that can't be read."""
    lines = computed_once(lines.select("ordinal", F.split("value", "\t").alias("cells__")))
    cols = F.col("cells__")
    named = {f: cell(header, f, cols) for f in header.fields}
    note = lambda kind, field: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    tests = [F.when(F.size(cols) < len(header.fields), note("short_row", "")), F.when(F.size(cols) > len(header.fields), note("extra_column", ""))]
    for f, c in named.items():
        kind = TYPES[log].get(f, "text")
        if kind in _BAD:
            tests.append(F.when((c["state"] == "value") & ~readable(c["value"], kind), note(_BAD[kind], f)))
        elif kind == "set":
            tests.append(F.when(answer_count(header, f, cols) < 0, note("bad_set", f)))
    rows = lines.select("ordinal", *(c.alias(f.replace(".", "_")) for f, c in named.items()), (F.size(cols) < len(header.fields)).alias("short_row"))
    found = lines.select("ordinal", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("d")).select("ordinal", "d.kind", "d.field")
    return rows, found


class _Cells:
    """Typed cells of a log's rows: texts, and numbers that are null where the cell has none that can be read."""

    def __init__(self, header: Header, log: str, cols: Column | None = None) -> None:
        self.header, self.log, self.cols = header, log, F.split("value", "\t") if cols is None else cols

    def text(self, field: str) -> Column:
        return cell(self.header, field, self.cols)["value"]

    def number(self, field: str, kind: str) -> Column:
        value = self.text(field)
        return F.when(readable(value, TYPES[self.log].get(field, "text")), value.try_cast(kind))

    def flag(self, field: str) -> Column:
        value = self.text(field)
        return F.when(value == "T", True).when(value == "F", False)

    def address(self, field: str) -> Column:
        value = self.text(field)
        return F.when(readable(value, "address"), value)

    def tuple(self) -> list[Column]:
        """When and between which ends: null where a cell can't be read."""
        return [
            F.col("ordinal").alias("source_ordinal"), self.number("ts", "double").alias("event_time"), self.address("id.orig_h").alias("src_ip"), self.number("id.orig_p", "int").alias("src_port"),
            self.address("id.resp_h").alias("dst_ip"), self.number("id.resp_p", "int").alias("dst_port"), self.text("proto").alias("proto"),
        ]


def _legacy_columns(c: _Cells, log: str) -> list[Column]:
    text = lambda f: F.coalesce(c.text(f), F.lit(""))
    number = lambda f, kind: F.coalesce(c.number(f, kind), F.lit(0).cast(kind))
    code = lambda f: F.coalesce(c.number(f, "int").cast("string"), F.lit(""))
    first = [text("uid").alias("uid"), number("ts", "double").alias("timestamp")]
    if log == "dns":
        return [*first, text("query").alias("query"), code("qtype").alias("qtype"), code("rcode").alias("rcode")]
    if log == "ssl":
        return [*first, text("version").alias("version"), text("cipher").alias("cipher"), c.text("ja3").alias("ja3"), c.text("ja3s").alias("ja3s"), text("server_name").alias("server_name")]
    return [*first, *(text(f).alias(f) for f in ("method", "host", "uri", "user_agent")), *(number(f, "long").alias(f) for f in ("request_body_len", "response_body_len")), number("status_code", "int").alias("status_code")]


def protocol_legacy(lines: DataFrame, header: Header, log: str) -> DataFrame:
    """dns, ssl or http rows that have all columns; numbers that are absent or unreadable are 0, texts are empty."""
    c = _Cells(header, log, F.col("cells__"))
    return lines.withColumn("cells__", F.split("value", "\t")).where(F.size(c.cols) >= len(header.fields)).select("ordinal", *_legacy_columns(c, log))


def protocol_rows(lines: DataFrame, header: Header, log: str) -> DataFrame:
    """All dns, ssl or http rows: the legacy columns, when and between which ends, and what detectors use beyond that."""
    c = _Cells(header, log, F.col("cells__"))
    more = []
    if log == "dns":
        flags = {"AA": "authoritative_answer", "TC": "truncated", "RD": "recursion_desired", "RA": "recursion_available", "rejected": "rejected"}
        count = answer_count(header, "answers", c.cols)
        more = [c.text("qtype_name").alias("qtype_name"), c.text("rcode_name").alias("rcode_name"), *(c.flag(f).alias(n) for f, n in flags.items()), c.number("Z", "int").alias("z"), F.when(count >= 0, count).alias("answer_count")]
    elif log == "ssl":
        more = [c.text("ja4").alias("ja4")]
    return lines.withColumn("cells__", F.split("value", "\t")).select(*_legacy_columns(c, log), *c.tuple(), *more)


def conn_lossless(lines: DataFrame, header: Header) -> tuple[DataFrame, DataFrame]:
    return lossless(lines, header, "conn")


def conn_legacy(lines: DataFrame, header: Header) -> DataFrame:
    """Rows with all columns; numbers that are absent or unreadable are 0, texts are empty."""
    c = _Cells(header, "conn", F.col("cells__"))
    text = lambda f: F.coalesce(c.text(f), F.lit(""))
    number = lambda f, kind: F.coalesce(c.number(f, kind), F.lit(0).cast(kind))
    whole = lines.withColumn("cells__", F.split("value", "\t")).where(F.size(c.cols) >= len(header.fields))
    return whole.select("ordinal", number("ts", "double").alias("ts"), text("uid").alias("uid"), text("id.orig_h").alias("src"), number("id.orig_p", "int").alias("src_port"), text("id.resp_h").alias("dst"), number("id.resp_p", "int").alias("dst_port"), text("proto").alias("proto"), text("service").alias("service"), number("duration", "double").alias("duration"), *(number(f, "long").alias(f) for f in ("orig_bytes", "resp_bytes")), text("conn_state").alias("conn_state"), *(number(f, "long").alias(f) for f in ("orig_pkts", "resp_pkts")))


LOGS = {"conn": "conn.log", "dns": "dns.log", "ssl": "ssl.log", "http": "http.log"}


def read_log_set(spark: SparkSession, folder: str, allow_empty: bool = False) -> dict[str, tuple[DataFrame, Header]]:
    """Lines and header of each log that a folder holds; without connections the others are an error, and so is a folder
    without any log, unless that is allowed."""
    jvm = spark.sparkContext._jvm
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [log for log, name in LOGS.items() if path(name).getFileSystem(conf).exists(path(name))]
    if "conn" not in there and (there or not allow_empty):
        raise ValueError(f"there is no {LOGS['conn']} in {folder}")
    found = {}
    for log in there:
        file = f"{folder.rstrip('/')}/{LOGS[log]}"
        found[log] = (read_lines(spark, file), read_header(spark, file))
    return found
