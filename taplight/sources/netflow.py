"""Exported flows: version 5 datagrams by expressions, version 9 by parts and templates as of each part, captures."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taplight.functions import codes
from taplight.sources import templates

V5_HEADER, V5_RECORD, V5_MOST = 24, 48, 30
WRAP = 1 << 32


def unsigned(hex_text: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of ``size`` bytes at byte ``at`` (from 0) of a hexadecimal text."""
    start = (F.lit(at) if isinstance(at, int) else at) * 2 + 1
    return F.conv(F.substring(hex_text, start, F.lit(size * 2)), 16, 10).cast("decimal(20,0)").cast("long")


def address(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def parse_v5(datagrams: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per record of each datagram (binary); ``reason`` tells why a datagram can't be read, it has one row then."""
    h = F.hex(payload)
    size = F.octet_length(payload)
    n = unsigned(h, 2, 2)
    reason = F.when(F.coalesce(size, F.lit(0)) < V5_HEADER, "short").when(unsigned(h, 0, 2) != 5, "version").when(~n.between(1, V5_MOST), "count").when(size != V5_HEADER + V5_RECORD * n, "length").when(unsigned(h, 12, 4) >= 1_000_000_000, "nanoseconds")
    head = datagrams.withColumns({"hex": h, "reason": reason}).withColumns(
        {"count": n, "uptime_ms": unsigned(F.col("hex"), 4, 4), "export_s": unsigned(F.col("hex"), 8, 4), "export_ns": unsigned(F.col("hex"), 12, 4), "sequence": unsigned(F.col("hex"), 16, 4), "engine_type": unsigned(F.col("hex"), 20, 1), "engine_id": unsigned(F.col("hex"), 21, 1), "sampling": unsigned(F.col("hex"), 22, 2)}
    )
    rows = head.withColumn("record", F.explode_outer(F.when(F.col("reason").isNull(), F.sequence(F.lit(0), F.col("count").cast("int") - 1))))
    at = F.col("record") * V5_RECORD + V5_HEADER
    of = lambda offset, size: unsigned(F.col("hex"), at + offset, size)
    return rows.withColumns(
        {
            "src": address(of(0, 4)), "dst": address(of(4, 4)), "input_if": F.nullif(of(12, 2), F.lit(0)), "output_if": F.nullif(of(14, 2), F.lit(0)), "packets": of(16, 4), "ip_bytes": of(20, 4), "first_ms": of(24, 4), "last_ms": of(28, 4), "src_port": of(32, 2), "dst_port": of(34, 2), "flag_bits": of(37, 1), "ip_protocol": of(38, 1),
            "sampling_mode": F.expr("sampling div 16384"), "sampling_interval": F.col("sampling") % 16384,
        }
    ).drop("hex", "sampling")


def v5_times(records: DataFrame, most_age_ms: int = 86_400_000) -> DataFrame:
    """Start and end in milliseconds since the epoch; ages are taken modulo 2^32, and one over the limit rejects."""
    age = F.pmod(F.col("uptime_ms") - F.col("last_ms"), F.lit(WRAP))
    length = F.pmod(F.col("last_ms") - F.col("first_ms"), F.lit(WRAP))
    end = F.col("export_s") * 1000 + F.expr("export_ns div 1000000") - age
    late = F.when((age > most_age_ms) | (length > most_age_ms), "age")
    return records.withColumns({"end_ms": end, "start_ms": end - length, "time_reason": late})


def v5_canonical(records: DataFrame) -> DataFrame:
    """Ports for protocols that have them, ICMP type and code from the destination port, flags for TCP only."""
    ported, icmp = F.col("ip_protocol").isin(6, 17, 132), F.col("ip_protocol") == 1
    names = codes.lookup(codes.PROTOCOLS, F.col("ip_protocol").cast("int"))
    return records.withColumns(
        {
            "proto": F.coalesce(names, F.concat(F.lit("ip_protocol_"), F.col("ip_protocol").cast("string"))), "icmp_type": F.when(icmp, F.expr("dst_port div 256")), "icmp_code": F.when(icmp, F.col("dst_port") % 256),
            "src_port": F.when(ported, F.col("src_port")), "dst_port": F.when(ported, F.col("dst_port")), "tcp_flags": F.when(F.col("ip_protocol") == 6, codes.tcp_flags(F.col("flag_bits").cast("int"))),
        }
    )


def sequence_relation(headers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """How each datagram follows the one before: first, in_order, gap, duplicate or regression (numbers modulo 2^32)."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.pmod(F.col("sequence") - (F.lag("sequence").over(w) + F.lag("count").over(w)), F.lit(WRAP))
    same = (F.lag("sequence").over(w) == F.col("sequence")) & (F.lag("count").over(w) == F.col("count"))
    relation = F.when(ahead.isNull(), "first").when(same, "duplicate").when(ahead == 0, "in_order").when(ahead < WRAP // 2, "gap").otherwise("regression")
    return headers.withColumns({"relation": relation, "lost": F.when(relation == "gap", ahead)})


def exporter_states(headers: DataFrame, keys: list[str], order: str, tolerance_ms: int = 1000) -> DataFrame:
    """Datagrams (sequence, count, uptime_ms, export_s, export_ns) with what their numbers and clocks say: ``sequence_state``,
    ``clock_state`` and ``lost`` records.

    What a datagram is held against is the last one that moved its exporter on: duplicates, steps back and datagrams
    whose clock can't be trusted don't.  Datagrams pass in order, and five numbers are kept for the exporter at hand.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    ordered = headers.withColumns({"es__first": first, "es__ms": F.col("export_s") * 1000 + F.floor(F.col("export_ns") / 1_000_000)}).sortWithinPartitions(*keys, order)
    own = headers.columns
    schema = StructType(list(headers.schema)).add("sequence_state", "string").add("clock_state", "string").add("lost", "long")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = count = uptime = ms = wraps = 0
        for batch in batches:
            out: list[tuple[str, str, int | None]] = []
            for new, s, c, u, at in zip(*(batch.column(x).to_pylist() for x in ("es__first", "sequence", "count", "uptime_ms", "es__ms")), strict=True):
                if new:
                    seq, count, uptime, ms, wraps = s, c, u, at, 0
                    out.append(("initial", "initial", None))
                    continue
                ahead = (s - seq - count) % WRAP
                relation = "in_order" if ahead == 0 else "duplicate" if s == seq else "gap" if ahead < WRAP // 2 else "regression"
                turned = relation == "in_order" and s < seq
                boot = ms - uptime - wraps * WRAP
                moves, around = relation in ("in_order", "gap"), wraps
                if at < ms:
                    clock, moves = "regressed", False
                elif u >= uptime:
                    clock = "shifted" if abs(at - u - wraps * WRAP - boot) > tolerance_ms else "in_order"
                elif relation == "regression" and abs(at - u - boot) > tolerance_ms:
                    relation, clock, moves, around = "restart", "restart", True, 0
                elif moves and abs((at - ms) - (u - uptime) % WRAP) <= 1000:
                    clock, around = "uptime_wrapped", wraps + 1
                else:
                    clock, moves = "ambiguous", False
                if moves:
                    seq, count, uptime, ms, wraps = s, c, u, at, around
                out.append(("wrapped" if turned else relation, clock, ahead if relation == "gap" else None))
            kept = [batch.column(c) for c in own]
            more = [pa.array([o[i] for o in out], k) for i, k in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*own, "sequence_state", "clock_state", "lost"])

    return ordered.mapInArrow(fold, schema)


# -- version 9 -----------------------------------------------------------------------------------------------------

V9_PARTS = "exporter string, ordinal long, source_id long, sequence long, uptime_ms long, export_s long, part int, kind string, template_id int, fields array<struct<id:int,size:int>>, body binary, reason string"
_FIELD = pa.list_(pa.struct([("id", pa.int32()), ("size", pa.int32())]))


def _v9_parts(data: bytes) -> tuple[tuple, list[tuple]]:
    """Header, and (kind, template, fields, body, reason) of each part of a datagram."""
    if len(data) < 20 or struct.unpack_from(">H", data)[0] != 9:
        return (None,) * 4, [("bad", None, None, None, "header")]
    _, _, uptime, seconds, sequence, source = struct.unpack_from(">HHIIII", data)
    parts: list[tuple] = []
    at = 20
    while at < len(data):
        if len(data) - at < 4:
            return (source, sequence, uptime, seconds), [("bad", None, None, None, "trailing bytes")]
        flowset, size = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > len(data):
            return (source, sequence, uptime, seconds), [("bad", None, None, None, "flowset length")]
        body = data[at + 4 : at + size]
        if flowset <= 1:
            found, whole = _template_parts(body, flowset == 1)
            parts += found
            if not whole:
                return (source, sequence, uptime, seconds), parts
        elif flowset > 255:
            parts.append(("data", flowset, None, body, None))
        at += size
    return (source, sequence, uptime, seconds), parts


def _template_parts(body: bytes, options: bool) -> tuple[list[tuple], bool]:
    """Parts of a template flowset, and whether what follows it can be read.

    A template that can't be used withdraws the one that it would replace; one whose end can't be told, or that can't
    be named, resets the exporter, and nothing after it counts.
    """
    parts: list[tuple] = []
    p, head = 0, 6 if options else 4
    while len(body) - p >= 4 and any(body[p:]):
        if len(body) - p < head:
            return [*parts, ("reset", None, None, None, "template length")], False
        template = struct.unpack_from(">H", body, p)[0]
        if options:
            scope, rest = struct.unpack_from(">HH", body, p + 2)
            odd, n = bool(scope % 4 or rest % 4), (scope + rest) // 4
            extent = head + scope + rest
        else:
            odd, n = False, struct.unpack_from(">H", body, p + 2)[0]
            extent = head + 4 * n
        if p + extent > len(body):
            return [*parts, ("reset", None, None, None, "template length")], False
        if template < 256:
            return [*parts, ("reset", None, None, None, "template number")], False
        flat = struct.unpack_from(f">{2 * n}H", body, p + head)
        fields = [{"id": flat[2 * i], "size": flat[2 * i + 1]} for i in range(n)]
        bad = odd or not 0 < n <= templates.MOST_FIELDS or any(f["size"] in (0, 65535) for f in fields)
        parts.append(("withdraw", template, None, None, "template layout") if bad else ("options" if options else "template", template, fields, None, None))
        p += extent
    return parts, bool(parts) or not body


def v9_parts(datagrams: DataFrame) -> DataFrame:
    """Templates and data of datagrams (exporter, ordinal, payload), in order; a bad datagram is one row with a reason."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ("exporter", "ordinal", "source_id", "sequence", "uptime_ms", "export_s", "part", "kind", "template_id", "fields", "body", "reason")]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.string(), pa.int32(), _FIELD, pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for exporter, ordinal, data in zip(*(batch.column(c).to_pylist() for c in ("exporter", "ordinal", "payload")), strict=True):
                head, parts = _v9_parts(data or b"")
                rows += [(exporter, ordinal, *head, i, *p) for i, p in enumerate(parts)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return datagrams.select("exporter", F.col("ordinal").cast("long").alias("ordinal"), "payload").mapInArrow(split, V9_PARTS)


def v9_registry(parts: DataFrame, ttl_s: int = templates.TTL_S) -> DataFrame:
    """Parts with what each did to its exporter's templates, or which template its data are read by (``definition``)."""
    kind_and_fields = F.to_json(F.struct(F.col("kind").alias("k"), F.col("fields").alias("f")))
    events = parts.where("kind <> 'bad'").withColumn("definition", F.when(F.col("kind").isin(*templates.DEFINES), kind_and_fields))
    return templates.transitions(events, ["ordinal", "part"], ttl_s=ttl_s)


def v9_records(parts: DataFrame, ttl_s: int = templates.TTL_S) -> DataFrame:
    """A row per data record, read by the template that its exporter's registry has for it at that moment.

    Data without one have a row with a reason: no template, an expired one, a clock that went back, or an options
    template, whose data are no flows.
    """
    known = v9_registry(parts, ttl_s).where("kind = 'data'")
    read = F.from_json("definition", "k string, f array<struct<id:int,size:int>>")
    data = known.withColumn("t", read).withColumns({"layout": F.when(F.col("t.k") == "template", F.col("t.f")), "why": F.when(F.col("t.k") == "options", "options data").when(F.col("action") == "expired", "expired template").when(F.col("action") == "clock", "clock").when(F.col("action") != "found", "no template")})
    size = F.aggregate("layout", F.lit(0), lambda a, f: a + f["size"])
    sized = data.withColumns({"size": size, "hex": F.hex("body")})
    whole = F.when((F.col("size") > 0) & (F.octet_length("body") >= F.col("size")), F.sequence(F.lit(0), F.expr("octet_length(body) div size").cast("int") - 1))
    rows = sized.withColumn("record", F.explode_outer(whole))
    starts = F.transform("layout", lambda f, i: F.aggregate(F.slice(F.col("layout"), F.lit(1), i), F.col("record") * F.col("size"), lambda a, g: a + g["size"]))
    fields = F.zip_with("layout", "starts", lambda f, s: F.struct(f["id"].alias("id"), f["size"].alias("size"), F.substring(F.col("hex"), s * 2 + 1, f["size"] * 2).alias("hex")))
    out = rows.withColumn("starts", starts).withColumn("fields", fields)
    # A field that a template names twice has its first value here; ``v9_normal`` compares them.
    firsts = F.filter("fields", lambda f, i: ~F.array_contains(F.transform(F.slice(F.col("fields"), F.lit(1), i), lambda g: g["id"]), f["id"]) & (f["size"] <= 8))
    values = F.map_from_entries(F.transform(firsts, lambda f: F.struct(f["id"], _number(f["hex"]))))
    out = out.withColumn("values", F.when(F.col("layout").isNotNull() & F.col("record").isNotNull(), values))
    return out.withColumn("reason", F.when(F.col("layout").isNull(), F.col("why")).when(F.col("record").isNull(), "short body")).select("exporter", "ordinal", "source_id", "sequence", "template_id", "part", "record", "fields", "values", "reason", "uptime_ms", "export_s")


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("decimal(20,0)")


# The supported elements of a record and the widths that each may have.
V9_WIDTHS = {1: (1, 8), 2: (1, 8), 4: (1, 1), 6: (1, 1), 7: (2, 2), 8: (4, 4), 10: (2, 8), 11: (2, 2), 12: (4, 4), 14: (2, 8), 21: (4, 4), 22: (4, 4), 27: (16, 16), 28: (16, 16), 32: (2, 2), 60: (1, 1)}


def address6(hex_text: Column) -> Column:
    """The shortest text of an IPv6 address: the first longest run of zero groups left out, mapped IPv4 as such."""
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.regexp_replace(F.substring(hex_text, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))), ":")
    short = groups
    for n in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
        short = F.when(groups.rlike(run), F.regexp_replace(groups, run, "$1::$2")).otherwise(short)
    mapped = F.upper(hex_text).rlike("^0{20}FFFF")
    return F.when(mapped, F.concat(F.lit("::ffff:"), address(_number(F.substring(hex_text, 25, 8)).cast("long")))).otherwise(short)


def v9_normal(records: DataFrame, ip_bytes: bool = False, most_age_ms: int = 86_400_000) -> DataFrame:
    """Records of ``v9_records`` as flows: each has its values, or the first reason for which it can't be one.

    Bytes count only where they are known to be those of IP (``ip_bytes``); what a record says twice alike is a note,
    what it says twice differently rejects it.
    """
    supported = F.filter("fields", lambda f: f["id"].isin(*(i for i in V9_WIDTHS if ip_bytes or i != 1)))
    rows = records.withColumn("known", supported)
    widths = F.create_map(*(x for i, (a, b) in V9_WIDTHS.items() for x in (F.lit(i), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
    wide = F.exists("known", lambda f: ~f["size"].between(widths[f["id"]]["a"], widths[f["id"]]["b"]))
    distinct_ids, distinct_values = F.array_distinct(F.transform("known", lambda f: f["id"])), F.array_distinct(F.transform("known", lambda f: F.struct(f["id"], F.ltrim(f["hex"], F.lit("0")))))
    raw = lambda i: F.get(F.filter("known", lambda f: f["id"] == i), 0)["hex"]
    n = lambda i: _number(raw(i))
    wrap = lambda a, b: F.pmod(a.cast("long") - b.cast("long"), F.lit(WRAP))
    family, six = n(60), raw(27).isNotNull() | raw(28).isNotNull()
    version = F.when(family.isNull() & ~six, F.lit(4)).otherwise(family.cast("int"))
    ends = lambda four, sixteen: F.when(version == 4, F.when(raw(four).isNotNull(), address(n(four).cast("long")))).otherwise(address6(raw(sixteen)))
    rows = rows.withColumns({"protocol": n(4).cast("int"), "src": ends(8, 27), "dst": ends(12, 28), "first_ms": n(22).cast("long"), "last_ms": n(21).cast("long"), "packets": n(2), "bytes": n(1)})
    end_age, length = wrap(F.col("uptime_ms"), F.col("last_ms")), wrap(F.col("last_ms"), F.col("first_ms"))
    limit = min(most_age_ms, 86_400_000)
    tests = {
        "field_width": wide,
        "ambiguous_field": F.size(distinct_values) > F.size(distinct_ids),
        "protocol": F.col("protocol").isNull(),
        "ip_version": family.isNotNull() & ~family.isin(4, 6),
        "address_family": family.isNull() & six,
        "src": F.col("src").isNull(),
        "dst": F.col("dst").isNull(),
        "start_time": F.col("first_ms").isNull(),
        "end_time": F.col("last_ms").isNull(),
        "time_order": ((F.col("last_ms") > F.col("uptime_ms")) & (end_age > limit)) | ((F.col("first_ms") > F.col("last_ms")) & (length > limit)) | (end_age + length >= WRAP),
        "age": (end_age > most_age_ms) | (length > most_age_ms),
        "counters": F.col("packets").isNull() & F.col("bytes").isNull(),
    }
    reason = F.coalesce("reason", *(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()))
    ported, protocol = F.col("protocol").isin(6, 17), F.col("protocol")
    interface = lambda i: F.when(n(i) != 0, F.concat(F.lit("ifindex:"), n(i).cast("string")))
    end_ms = F.col("export_s") * 1000 - end_age
    named = F.coalesce(codes.lookup(codes.PROTOCOLS, protocol), F.concat(F.lit("ip_protocol_"), protocol.cast("string")))
    made = {"proto": named, "src_port": F.when(ported, n(7).cast("int")), "dst_port": F.when(ported, n(11).cast("int")), "icmp_type": F.when(protocol == 1, F.floor(n(32) / 256).cast("int")), "icmp_code": F.when(protocol == 1, (n(32) % 256).cast("int")), "tcp_flags": F.when(protocol == 6, codes.tcp_flags(n(6).cast("int"))), "input_if": interface(10), "output_if": interface(14), "start_ms": end_ms - length, "end_ms": end_ms}
    notes = F.filter(F.array(F.when(F.size("known") > F.size(distinct_ids), "duplicate"), F.when(F.lit(not ip_bytes) & F.exists("fields", lambda f: f["id"] == 1), "bytes_left_out")), lambda x: x.isNotNull())
    return rows.withColumns({**made, "notes": notes, "reason": reason}).drop("known", "first_ms", "last_ms")


def v9_audit(normal: DataFrame) -> DataFrame:
    """How many records were taken, and rejected for which reason."""
    return normal.groupBy(F.coalesce("reason", F.lit("taken")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def udp_filter(packets: DataFrame, exporters: tuple[str, ...] = (), collectors: tuple[str, ...] = (), ports: tuple[int, ...] = ()) -> DataFrame:
    """UDP packets of a capture from the exporters to the collectors and ports that are given; none given lets all pass."""
    out = packets.where("reason is null")
    for column, chosen in (("src", exporters), ("dst", collectors), ("dst_port", ports)):
        if chosen:
            out = out.where(F.col(column).isin(*chosen))
    return out


def wire_bytes(text: Column) -> Column:
    """Datagrams from hexadecimal text: white space is left out; null for other text, an odd number of digits or more
    than a datagram holds."""
    digits = F.regexp_replace(text, r"\s+", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})+$") & (F.length(digits) <= 2 * 65535), F.unhex(digits))


def datagram_files(spark, path: str, most_bytes: int = 65535, sha256: str | None = None) -> DataFrame:
    """(path, payload, reason): one datagram to a file, too large ones and those of another digest with a reason."""
    files = spark.read.format("binaryFile").load(path)
    reason = F.when(F.col("length") > most_bytes, "size").when(F.lit(False) if sha256 is None else F.sha2("content", 256) != sha256.lower(), "digest")
    return files.select("path", F.when(reason.isNull(), F.col("content")).alias("payload"), reason.alias("reason"))


def capture_to_v5(files: DataFrame) -> DataFrame:
    """Version 5 records of the UDP packets of captures, under the exporter that sent each."""
    packets = udp_filter(read_capture(files)).select(F.col("src").alias("exporter"), "path", "ordinal", "payload")
    return v5_canonical(v5_times(parse_v5(packets)).where("reason is null and time_reason is null"))


# -- captures ------------------------------------------------------------------------------------------------------

PACKETS = "path string, ordinal long, ts_ns long, src string, dst string, src_port int, dst_port int, payload binary, reason string"


def _packets(data: bytes) -> Iterator[tuple]:
    """(time, frame) of a classic capture; fatal damage raises."""
    orders = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
    if len(data) < 24 or data[:4] not in orders:
        raise ValueError("not a classic capture")
    order, unit = orders[data[:4]]
    major, minor, _, _, snap, link = struct.unpack_from(f"{order}HHiIII", data, 4)
    if (major, minor, link) != (2, 4, 1):
        raise ValueError("neither version 2.4 nor Ethernet")
    at = 24
    while at < len(data):
        if at + 16 > len(data):
            raise ValueError("a packet header is cut off")
        seconds, fraction, kept, length = struct.unpack_from(f"{order}IIII", data, at)
        if kept > snap or kept > length or at + 16 + kept > len(data) or fraction * unit >= 1_000_000_000:
            raise ValueError("a packet's sizes or time are wrong")
        yield seconds * 1_000_000_000 + fraction * unit, data[at + 16 : at + 16 + kept], kept < length
        at += 16 + kept


def _udp(frame: bytes, cut: bool) -> tuple:
    """Addresses, ports, payload and reason of a frame that should hold UDP over IPv4, with one tag at most."""
    none = (None, None, None, None, None)
    at, kind = 14, int.from_bytes(frame[12:14], "big")
    if kind == 0x8100:
        at, kind = 18, int.from_bytes(frame[16:18], "big")
    if kind == 0x8100:
        return (*none, "two tags")
    if kind != 0x0800 or len(frame) < at + 20:
        return (*none, "not IPv4")
    head = (frame[at] & 15) * 4
    if frame[at] >> 4 != 4 or head < 20 or cut:
        return (*none, "cut or bad header")
    total, fragment = struct.unpack_from(">H2xH", frame, at + 2)
    if fragment & 0x3FFF:
        return (*none, "fragment")
    if frame[at + 9] != 17:
        return (*none, "not UDP")
    udp = at + head
    if len(frame) < udp + 8 or total < head + 8:
        return (*none, "short UDP")
    sport, dport, size = struct.unpack_from(">HHH", frame, udp)
    if size < 8 or udp + size > len(frame):
        return (*none, "UDP length")
    ip = lambda i: ".".join(map(str, frame[i : i + 4]))
    return ip(at + 12), ip(at + 16), sport, dport, frame[udp + 8 : udp + size], None


def read_capture(files: DataFrame) -> DataFrame:
    """UDP datagrams of captures: ``files`` are rows of the binaryFile source; packets that hold none have a reason."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                held = [(path, i, ts, *_udp(frame, cut)) for i, (ts, frame, cut) in enumerate(_packets(data))]
                cols = list(zip(*held, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(rows, PACKETS)
