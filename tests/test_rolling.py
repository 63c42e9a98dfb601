"""Rolling windows against their definition, row by row."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taplight.functions import rolling as roll


def _rows(seed, n=260, keys=("a", "b", None), step=500_000, spread=120):
    r = random.Random(seed)
    return [(i, r.choice(keys), r.randrange(spread) * step, r.choice([None, 1, 2, 3, 4]), r.choice("xyz"), r.choice([None, 5, 7, 100]), r.choice([None, 0.25, 1.5, -3.0, 1e6] + [math.nan, math.inf, -math.inf] * (i % 9 == 0))) for i in range(n)]


SCHEMA = "flow_id long, k string, ts_us long, port int, host string, size long, amount double"


@pytest.mark.parametrize("closed", [False, True])
def test_measures_equal_their_definitions(spark, closed):
    span = 3_000_000
    rows = _rows(1 + closed)
    measures = {
        "n": roll.count(),
        "sizes": roll.known("size"),
        "bytes": roll.total("size"),
        "ports": roll.distinct("port"),
        "ends": roll.distinct(F.struct("port", "host")),
        "top": roll.largest("size"),
        "low": roll.least("size"),
        "first": roll.first_time(),
        "gap": roll.gaps(),
        "logs": roll.count_logs("host"),
        "fan": roll.widest("port", "host"),
        "last_port": roll.latest("port"),
        "amounts": roll.total("amount"),
    }
    got = {x["flow_id"]: x for x in roll.Rolling(("k",), span, closed).over(spark.createDataFrame(rows, SCHEMA), measures).collect()}
    assert len(got) == len(rows)
    for i, k, t, *_ in rows:
        w = sorted((b for b in rows if b[1] == k and ((b[2] >= t - span) if closed else (b[2] > t - span)) and (b[2], b[0]) <= (t, i)), key=lambda b: (b[2], b[0]))
        x = got[i]
        sizes = [b[5] for b in w if b[5] is not None]
        gaps = [b[2] - a[2] for a, b in zip(w, w[1:], strict=False) if b[2] > a[2]]
        hosts = defaultdict(set)
        for b in w:
            if b[3] is not None:
                hosts[b[3]].add(b[4])
        assert (x["n"], x["sizes"], x["bytes"]) == (len(w), len(sizes), sum(sizes))
        assert (x["ports"], x["ends"]) == (len({b[3] for b in w} - {None}), len({b[3:5] for b in w}))
        assert (x["top"], x["low"], x["first"]) == (max(sizes, default=None), min(sizes, default=None), w[0][2])
        assert (x["gap"]["n"], x["gap"]["us"], int(x["gap"]["squares"])) == (len(gaps), sum(gaps), sum(g * g for g in gaps))
        assert abs(x["logs"] - sum(c * math.log2(c) for c in Counter(b[4] for b in w).values())) < 1e-9
        assert x["fan"] == max((len(h) for h in hosts.values()), default=0)
        assert x["last_port"] == next((b[3] for b in reversed(w) if b[3] is not None), None)
        parts = [b[6] for b in w if b[6] is not None]
        if any(map(math.isnan, parts)) or {math.inf, -math.inf} <= set(parts):
            assert math.isnan(x["amounts"])
        else:
            assert x["amounts"] == (math.fsum(parts) if not any(map(math.isinf, parts)) else next(p for p in parts if math.isinf(p)))


def test_values_that_left_leave_no_trace_in_sums(spark):
    rows = [(i, "a", i * 10, 1, "x", 1, v) for i, v in enumerate([1e17, 0.3, 0.1, math.nan, 0.5, math.inf, -math.inf, 0.25, None, 0.25])]
    got = [x["s"] for x in roll.Rolling(("k",), 20).over(spark.createDataFrame(rows, SCHEMA), {"s": roll.total("amount")}).orderBy("flow_id").collect()]
    assert got[2] == 0.4 and got[8:] == [0.25, 0.25] and [math.isnan(v) for v in got[3:8]] == [True, True, False, True, False] and got[5] == math.inf and got[7] == -math.inf


def test_one_key_is_dealt_over_many_chunks_and_no_edge_shows(spark):
    day = 86_400_000_000
    r = random.Random(2)
    rows = [(i, "a", r.randrange(60 * day), r.choice([None, 1, 2, 3]), r.choice("xyz"), 1, None) for i in range(400)]
    window = roll.Rolling(("k",), 3 * day)
    assert window.chunk == 2 and roll.Rolling(("k",), 10_000_000).chunk == 16
    got = {x["flow_id"]: x for x in window.over(spark.createDataFrame(rows, SCHEMA), {"n": roll.count(), "last": roll.latest("port"), "fan": roll.widest("port", "host")}).collect()}
    for i, _, t, *_ in rows:
        w = sorted((b for b in rows if t - 3 * day < b[2] and (b[2], b[0]) <= (t, i)), key=lambda b: (b[2], b[0]))
        hosts = defaultdict(set)
        for b in w:
            if b[3] is not None:
                hosts[b[3]].add(b[4])
        assert (got[i]["n"], got[i]["last"], got[i]["fan"]) == (len(w), next((b[3] for b in reversed(w) if b[3] is not None), None), max(map(len, hosts.values()), default=0))


def test_latest_rows_only(spark):
    rows = _rows(5, spread=20)
    got = {x["flow_id"]: x for x in roll.Rolling(("k",), 4_000_000).over(spark.createDataFrame(rows, SCHEMA), {"n": roll.count(), "bytes": roll.total("size")}, latest_rows=7).collect()}
    for i, k, t, *_ in rows:
        w = sorted((b for b in rows if b[1] == k and b[2] > t - 4_000_000 and (b[2], b[0]) <= (t, i)), key=lambda b: (b[2], b[0]))[-7:]
        assert (got[i]["n"], got[i]["bytes"]) == (len(w), sum(b[5] or 0 for b in w))


def test_many_ties_and_empty_tables(spark):
    ties = 10_000
    rows = [(i, "a", 0, 1, "x", 1, None) for i in range(ties)] + [(ties + i, "a", 10, 2, "y", 1, None) for i in range(3)] + [(ties + 9, "a", None, 1, "x", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for closed in (False, True):
        got = {x["flow_id"]: (x["n"], x["ports"]) for x in roll.Rolling(("k",), 10, closed).over(df, {"n": roll.count(), "ports": roll.distinct("port")}).collect()}
        assert got[ties - 1] == (ties, 1) and got[ties + 2] == ((ties + 3, 2) if closed else (3, 1)) and ties + 9 not in got
    assert roll.Rolling(("k",), 10).over(df.limit(0), {"n": roll.count()}).count() == 0


def test_totals_see_all_rows_of_their_own_instant(spark):
    span = 3_000_000
    rows = _rows(5)
    measures = {"n": roll.count(), "bytes": roll.total("size")}
    windows = roll.Rolling(("k",), span, instant=True)
    got = {x["flow_id"]: (x["n"], x["bytes"]) for x in windows.over(spark.createDataFrame(rows, SCHEMA), measures).collect()}
    for i, k, t, *_ in rows:
        seen = [x for x in rows if x[1] == k and t - span < x[2] <= t]
        assert got[i] == (len(seen), sum(x[5] or 0 for x in seen))
    with pytest.raises(ValueError):
        windows.over(spark.createDataFrame(rows, SCHEMA), {"ports": roll.distinct("port")})
