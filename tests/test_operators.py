"""Edges of windows, folds and readers, against small models in Python."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from taplight.operators import detectors, emit, enrich, evaluate
from taplight.sources import canonical, features, netflow, shared, zeek


def test_cooldown_and_escalation(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), i * r.randrange(1, 4), r.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "flow_id long, k string, ts_us long, rank int")
    want, state = set(), {}
    for i, k, t, rank in sorted(rows, key=lambda x: (x[2], x[0])):
        last = state.get(k)
        if last is None or t - last[0] >= 25 or rank > last[1]:
            state[k] = (t, rank)
            want.add(i)
    assert {x["flow_id"] for x in emit.cooldown(df, ["k"], 25).collect()} == want


def test_flood_threshold_edges(spark):
    flood = detectors.Flood(window_us=10, cooldown_us=100, sources=3, flows=4, packets=1000)
    rows = [(i, f"s{i % n}", "d%d" % n, i, None) for n in (2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "flow_id long, src string, dst string, ts_us long, orig_pkts long")
    assert [(x["dst"], x["ts_us"]) for x in flood(df).collect()] == [("d3", 3)]


def test_intervals_meet_once(spark):
    points = spark.createDataFrame([("a", 95, 105), ("a", 500, 500), ("b", 95, 105)], "k string, s long, e long")
    spans = spark.createDataFrame([("a", 0, 90), ("a", 100, 300), ("a", 511, 600)], "k string, lo long, hi long")
    got = sorted((x["s"], x["lo"]) for x in enrich.interval_join(points, spans, ["k"], "s", "e", "lo", "hi", 10, 50).collect())
    assert got == [(95, 0), (95, 100)]


def test_log_header_and_cells(spark):
    header = zeek.parse_header(["#fields\tts\tuid\tanswers", "#set_separator\t|"])
    with pytest.raises(ValueError):
        zeek.parse_header(["#path\tconn"])
    lines = spark.createDataFrame([(0, "1\t-\ta|b"), (1, "2\t(empty)\ta||b"), (2, "3")], "ordinal long, value string")
    rows = lines.select(zeek.cell(header, "uid")["state"], zeek.answer_count(header, "answers")).collect()
    assert [tuple(x) for x in rows] == [("unset", 2), ("empty", -1), ("missing", None)]


def test_records_are_rejected_for_stated_reasons(spark, tmp_path):
    good = '{"flow_id": "a:1.5", "src_ip": "1", "dst_ip": "2", "proto": "tcp", "duration": 0, "orig_bytes": 1, "resp_bytes": 2, "orig_pkts": 3, "resp_pkts": 4%s}'
    more = ', "dns": {"uid": "u", "transaction_count": 2}, "dns_transactions": [{"uid": "u", "source_ordinal": %d}, {"uid": "%s", "source_ordinal": 2}]'
    lines = [good % "", good % (more % (1, "u")), good % (more % (2, "v")), "", '{"a"', good % ', "dst_port": true']
    (tmp_path / "f").write_text("\n".join(lines))
    flows, rejects = features.read(spark, str(tmp_path / "f"))
    assert [x["event_time"] for x in flows.collect()] == [1.5, 1.5]
    assert sorted(",".join(x["reasons"]) for x in rejects.collect()) == ["json", "transaction_uids,transaction_order", "type_dst_port"]
    with pytest.raises(ValueError):
        features.read(spark, str(tmp_path / "f"), strict=True)


def test_version_5_damage(spark):
    head = struct.pack(">HHIIIIBBH", 5, 1, 10, 20, 0, 7, 0, 0, 0)
    grams = [(0, head + bytes(48)), (1, head), (2, b"x"), (3, None), (4, head[:2] + b"\0\x1f" + head[4:])]
    rows = netflow.parse_v5(spark.createDataFrame(grams, "id int, payload binary")).select("id", "reason").collect()
    assert dict(rows) == {0: None, 1: "length", 2: "short", 3: "short", 4: "count"}


def test_version_9_templates_as_of(spark):
    def gram(at, body):
        return struct.pack(">HHIIII", 9, 1, 0, at, 0, 1) + body

    layout = struct.pack(">HHHHHH", 0, 12, 256, 1, 1, 4)
    data = struct.pack(">HHII", 256, 12, 5, 6)
    grams = [("e", 0, gram(0, data)), ("e", 1, gram(1, layout)), ("e", 2, gram(2, data)), ("e", 3, gram(9999, data)), ("f", 4, gram(3, data)), ("e", 5, b"bad")]
    parts = netflow.v9_parts(spark.createDataFrame(grams, "exporter string, ordinal long, payload binary"))
    rows = [(x["exporter"], x["ordinal"], x["reason"], int(x["values"][1]) if x["values"] else None) for x in netflow.v9_records(parts).collect()]
    assert sorted(rows, key=str) == sorted([("e", 0, "no template", None), ("e", 2, None, 5), ("e", 2, None, 6), ("e", 3, "expired template", None), ("f", 4, "no template", None)], key=str)
    assert parts.where("kind = 'bad'").count() == 1


def test_capture(spark, tmp_path):
    udp = struct.pack(">HHHH", 9, 2055, 12, 0) + b"data"
    ip = bytes([0x45, 0]) + struct.pack(">HHHBBH", 20 + len(udp), 0, 0, 64, 17, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    frames = [bytes(12) + b"\x08\x00" + ip + udp, bytes(12) + b"\x86\xdd" + ip]
    file = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, 5, len(f), len(f)) + f for f in frames)
    (tmp_path / "c.pcap").write_bytes(file)
    rows = netflow.read_capture(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("ordinal").collect()
    assert (rows[0]["src"], rows[0]["dst_port"], bytes(rows[0]["payload"]), rows[0]["ts_ns"]) == ("10.0.0.1", 2055, b"data", 1_000_005_000)
    assert rows[1]["reason"] == "not IPv4"


def test_longest_suffix_and_links(spark):
    hosts = spark.createDataFrame([("a.b.c",), ("c",), ("x",)], "host string")
    got = dict(enrich.longest_suffix(hosts, spark.createDataFrame([("c",), ("b.c",)], "suffix string")).select("host", "suffix").collect())
    assert got == {"a.b.c": "b.c", "c": "c", "x": None}


def test_addresses_are_texts_of_addresses(spark):
    import ipaddress

    from pyspark.sql import functions as F

    r = random.Random(3)
    sixes = [bytes(16), bytes(15) + b"\1", b"\xff" * 16, bytes(10) + b"\xff\xff" + bytes([1, 2, 3, 4])] + [bytes(r.choice([0, 0, 0, 1, 0x20, 0xAB]) for _ in range(16)) for _ in range(200)]
    sixes = [b for b in sixes if b[:10] != bytes(10) or b[10:12] in (b"\xff\xff", bytes(2)) or True]
    df = spark.createDataFrame([(b.hex(),) for b in sixes], "h string")
    for h, text in df.select("h", netflow.address6(F.col("h"))).collect():
        a = ipaddress.IPv6Address(bytes.fromhex(h))
        assert ipaddress.IPv6Address(text) == a
        if not a.ipv4_mapped:
            assert text == str(a)
    good = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "fe80::1:2", "1::8"]
    bad = ["999.1.1.1", "1.2.3", "01.2.3.4", "1.2.3.4.5", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::1", "12345::", "::1.2.3.256", "", "not-an-ip"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", zeek.readable(F.col("x"), "address").alias("ok")).collect()
    assert {x["x"] for x in rows if x["ok"]} == set(good)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    text = "#separator \\x09\n#fields\tts\tuid\n" + "".join(f"# note {i}\n" if i % 10 == 0 else ("\n" if i % 10 == 5 else f"{i}\tC{i}\n") for i in range(5000)) + "#close\n"
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("#fields\tts\tuid\n7\tx\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = zeek.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ours = sorted((x["ordinal"], x["value"]) for x in rows if x["file"].endswith("a.log"))
    assert ours == list(enumerate(f"{i}\tC{i}" for i in range(5000) if i % 5))
    assert [(x["ordinal"], x["value"]) for x in rows if x["file"].endswith("b.log")] == [(0, "7\tx")]
    assert zeek.read_header(spark, str(tmp_path)).fields == ("ts", "uid")
    (tmp_path / "c.log").write_text("#fields\tuid\tts\n")
    with pytest.raises(ValueError):
        zeek.read_header(spark, str(tmp_path))


def test_log_sets_need_connections(spark, tmp_path):
    with pytest.raises(ValueError):
        zeek.read_log_set(spark, str(tmp_path))
    assert zeek.read_log_set(spark, str(tmp_path), allow_empty=True) == {}
    (tmp_path / "dns.log").write_text("#fields\tts\n1\n")
    with pytest.raises(ValueError):
        zeek.read_log_set(spark, str(tmp_path), allow_empty=True)
    (tmp_path / "conn.log").write_text("#fields\tts\n1\n2\n")
    found = zeek.read_log_set(spark, str(tmp_path))
    assert set(found) == {"conn", "dns"} and found["conn"][0].count() == 2


def test_datagrams_from_files_and_text(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F

    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abcdef")
    digest = hashlib.sha256(b"abc").hexdigest()
    rows = {x["path"][-5:]: (x["payload"], x["reason"]) for x in netflow.datagram_files(spark, str(tmp_path), 5, digest).collect()}
    assert rows == {"a.bin": (bytearray(b"abc"), None), "b.bin": (None, "size")}
    text = spark.createDataFrame([("61 62\n63",), ("616",), ("6x",), ("",)], "t string")
    assert [x[0] for x in text.select(netflow.wire_bytes(F.col("t"))).collect()] == [bytearray(b"abc"), None, None, None]


def test_shown_numbers_equal_python(spark):
    from pyspark.sql import functions as F

    from taplight.functions import text

    r = random.Random(4)
    values = [0.0, 1.0, -3.0, 0.5, 0.91, 12345.6, 1234.56, 9.9996, 0.00012346, 0.000012346, 1e20, -2.5e-7, 99999.5] + [r.uniform(-1, 1) * 10 ** r.randrange(-6, 7) for _ in range(100)]
    want = [str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.4g}" for v in values]
    got = [x[0] for x in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(text.shown_number(F.col("v"))).collect()]
    assert got == want


def test_states_types_and_ports_are_the_formats():
    from taplight.functions import codes

    assert codes.CONN_STATES == dict(enumerate(("S1", "S2", "S3", "SF", "REJ", "RSTO", "RSTOS0", "RSTR", "RSTRH", "SH", "SHR", "OTH"), 1))
    assert set(codes.COMPLETE_STATES) | set(codes.INCOMPLETE_STATES) == set(codes.CONN_STATES.values()) - {"OTH"} | {"S0"}
    assert detectors.Beacon().service_ports == (67, 68, 123, 137, 138, 389, 636, 1900, 3268, 3269, 5353, 5355)
    assert (codes.QTYPES[35], codes.QTYPES[65], codes.QTYPES[252], codes.RCODES[10], codes.TLS_VERSIONS[5], codes.HTTP_METHODS[9]) == ("NAPTR", "HTTPS", "AXFR", "NOTZONE", "SSLv3", "PATCH")


def test_exporters_wrap_restart_and_lose_their_clock(spark):
    wrap = 1 << 32
    rows = [  # ordinal, sequence, count, uptime, export
        (0, wrap - 2, 2, wrap - 3000, 100), (1, 0, 1, wrap - 2000, 101), (2, 1, 1, 500, 103), (3, 1, 1, 600, 103), (4, 2, 1, 1500, 104), (5, 0, 1, 10, 200), (6, 1, 1, 1010, 201), (7, 2, 1, 5, 202),
    ]
    heads = spark.createDataFrame([("e", *r, 0) for r in rows], "e string, ordinal long, sequence long, count long, uptime_ms long, export_s long, export_ns long")
    got = [(x["sequence_state"], x["clock_state"]) for x in netflow.exporter_states(heads, ["e"], "ordinal").orderBy("ordinal").collect()]
    assert got == [("initial", "initial"), ("wrapped", "in_order"), ("in_order", "uptime_wrapped"), ("duplicate", "in_order"), ("in_order", "in_order"), ("restart", "restart"), ("in_order", "in_order"), ("in_order", "ambiguous")]


def test_order_statistics_hold_whatever_order_the_bounds_come_of(spark, monkeypatch):
    """Bounds that differ each time they are made, as a sketch's do where shuffled blocks come in another order."""
    monkeypatch.setattr(F, "percentile_approx", lambda c, *_: F.udf(lambda top: sorted(random.uniform(0, top) for _ in range(9)), "array<double>").asNondeterministic()(F.max(c)))
    rows = spark.range(1, 1001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    with shared.settings(spark, {"spark.sql.exchange.reuse": "false"}):
        got = evaluate.order_statistics(rows, ["g"], "v", {"p10": F.lit(50), "top": F.col("n")}).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(0, 500, 100.0, 1000.0), (1, 500, 99.0, 999.0)]


def test_canonical_times_are_exact_and_of_the_calendar(spark):
    good = {"1969-12-31T23:59:59.5Z": None, "1969-12-31T23:59:59.500Z": -500_000_000, "2024-02-29T00:00:00Z": 1_709_164_800_000_000_000, "9999-12-31T23:59:59.999999999Z": 253_402_300_799_999_999_999}
    bad = ["2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:60Z", "0000-01-01T00:00:00Z", "2024-01-01T00:00:00.12Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00Z\n", "", None]
    want = good | dict.fromkeys(bad)
    times = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["n"] if r["n"] is None else int(r["n"]) for r in times.select("t", canonical.nanoseconds(F.col("t")).alias("n")).collect()} == want


def test_canonical_records_are_read_once(spark):
    """A record's JSON is parsed by one expression, however many of its fields are looked at."""
    lines = spark.range(9).select(F.concat(F.lit('{"record_id":"'), "id", F.lit('"}')).alias("value"))
    flows = canonical.to_flows(canonical.parse(lines), {6: "tcp"})
    assert flows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


@pytest.mark.parametrize(("loose", "fill"), [(True, False), (False, True)])
def test_flows_that_match_a_row_by_all_pairs(spark, loose, fill):
    r = random.Random(11)
    some = lambda *of: r.choice(of)
    made = lambda i: (i, some("u", "v", None), some("a", "b"), some("x", "x", None), some(6, 17, None), some(1, 2, None), some(3, None))
    rows, flows = [made(i) for i in range(150)], [made(i) for i in range(14)]
    columns = "uid string, src string, dst string, proto int, sport int, dport int"
    known = spark.createDataFrame([(*f[1:], f"r{f[0]}") for f in flows], f"{columns}, record_id string")
    met = enrich.match_flows(spark.createDataFrame(rows, f"i int, {columns}"), known, "i", loose, ("sport", "dport"), fill)
    got = {x["i"]: (x["proto"] if fill else None, x["outcome"], x["record_id"]) for x in met.collect()}
    for i, uid, src, dst, proto, *ports in rows:
        candidates = [f for f in flows if uid is not None and f[1] == uid]
        near = [f for f in candidates if f[2] == src and dst is not None and f[3] == dst]
        if fill and proto is None and len(near) == 1:
            proto, near = near[0][4], [(*near[0][:4], "taken", *near[0][5:])]
            fits, own = near, proto
        else:
            fits, own = [f for f in near if proto is not None and f[4] == proto], proto
        same = lambda a, b: (a == b and a is not None) or (loose and (a is None or b is None))
        fits = [f for f in fits if all(same(a, b) for a, b in zip(ports, f[5:], strict=True))]
        outcome = "linked" if len(fits) == 1 else "ambiguous" if fits else "inconsistent" if candidates else "unlinked"
        assert got[i] == (own if fill else None, outcome, f"r{fits[0][0]}" if len(fits) == 1 else None)
