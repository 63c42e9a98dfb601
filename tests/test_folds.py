"""Folds against their definitions, row by row: islands, cooldown, findings, templates; streams go on where they stopped; family split."""

import random

import pytest

from taplight.operators import domain_model, emit
from taplight.operators.detectors import Flood, Scan
from taplight.sources.templates import Registry
from taplight.streaming import ordered


def _rows(seed, n=400, spread=400_000):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", None]), r.randrange(spread), i, r.randrange(4)) for i in range(n)]


SCHEMA = "k string, ts_us long, flow_id long, rank int"


@pytest.mark.parametrize("gap", [100, 1000, 5000])
def test_islands_and_cooldown(spark, gap):
    rows = _rows(gap)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["flow_id"]: x["i"] for x in emit.islands(df, ["k"], gap, "ts_us", "flow_id", "i").collect()}
    kept = {x["flow_id"] for x in emit.cooldown(df, ["k"], gap).collect()}
    want, emitted = {}, set()
    for key in ("a", "b", None):
        begin = before = last = top = None
        for _, t, i, rank in sorted((x for x in rows if x[0] == key), key=lambda x: x[1:3]):
            if before is None or t - before > gap:
                begin = t
            want[i], before = begin, t
            if last is None or t - last >= gap or rank > top:
                emitted.add(i)
                last, top = t, rank
    assert got == want and kept == emitted


def test_rows_without_a_time_emit_as_the_first_of_their_key_only(spark):
    df = spark.createDataFrame([("a", None, 1, 2), ("a", 5, 2, 1), ("a", 900, 3, 3), ("b", None, 4, 1)], SCHEMA)
    assert {x["flow_id"] for x in emit.cooldown(df, ["k"], 10).collect()} == {1, 3, 4}
    assert emit.cooldown(df.limit(0), ["k"], 10).count() == 0


def test_an_id_counts_again_once_it_is_forgotten(spark):
    ids = [1, 1, 2, *range(3, 19), 1, 18]
    df = spark.createDataFrame([("x", t, i, 0.5) for t, i in enumerate(ids)] + [("x", 500, 18, 0.9)], "k string, ts_us long, alert_id long, score double")
    got = sorted(tuple(x) for x in emit.fold_repeats(df, ["k"], 100).select("first_seen", "occurrences", "last_seen", "max_score").collect())
    assert got == [(0, 19, 19, 0.5), (500, 1, 500, 0.9)]


def test_a_templates_life():
    r = Registry(ttl_s=10, most=2)
    see = lambda *event: r.apply(*event)[:2]
    assert see("data", 0, 256, None, 5) == ("unknown", None) and not r.clocks
    assert see("template", 0, 256, "x", 5) == ("inserted", 1)
    assert see("template", 0, 256, "x", 6) == ("refreshed", 1) and see("template", 0, 256, "y", 7) == ("replaced", 2)
    assert r.apply("data", 0, 256, None, 16) == ("found", 2, 0, "y")
    assert see("data", 0, 256, None, 15) == ("clock", None) and see("template", 0, 256, "z", 3) == ("clock", None)
    assert see("template", 1, 256, "x", 1) == ("inserted", 1) and see("template", 1, 257, "x", 2) == ("full", None)
    assert see("data", 0, 256, None, 17) == ("expired", 2) and see("data", 0, 256, None, 1) == ("unknown", None)
    assert see("withdraw", 1, 256, None, 3) == ("withdrawn", 1) and see("withdraw", 1, 256, None, 1) == ("unknown", None)
    r.apply("options", 1, 300, "o", 4)
    assert r.apply("reset", 1, None, None, 0) == ("reset", None, 1, None) and not r.entries and not r.clocks


@pytest.mark.parametrize("make", [lambda: ordered.FloodFold(Flood(window_us=50, cooldown_us=20, sources=3, flows=4, packets=30)), lambda: ordered.ScanFold(Scan(window_us=60, cooldown_us=30, ports=3, service_ports=2, fanout=2, answered=0.9))])
def test_rules_go_on_where_they_stopped(make):
    import json

    r = random.Random(6)
    rows = [{"ts_us": t, "flow_id": t, "src": r.choice("abcde"), "dst": r.choice("xyz"), "port": r.choice([None, 1, 2, 3, 4]), "state": r.choice([None, "S0", "SF", "odd"]), "resp_bytes": r.choice([None, 0, 500]), "orig_pkts": r.choice([None, 5, 20])} for t in range(0, 900, 3)]
    whole = make()
    whole.load(None)
    want = [whole.step(x) for x in rows]
    got, kept = [], None
    for x in rows:
        again = make()
        again.load(kept)
        got.append(again.step(x))
        kept = json.loads(json.dumps(again.dump()))
    assert got == want and sum(x is not None for x in want) > 3


def test_no_family_is_on_both_sides(spark):
    r = random.Random(4)
    rows = [(f"n{i}", 1, f"f{r.randrange(20)}") for i in range(900)] + [(f"b{i}", 0, None) for i in range(800)]
    df = spark.createDataFrame(rows, "domain string, label int, family string")
    got = domain_model.split_by_family(df).collect()
    sides = {t: {x["family"] for x in got if x["label"] == 1 and x["test"] == t} for t in (True, False)}
    assert len(got) == len(rows) and sides[True] and sides[False] and not sides[True] & sides[False]
    for label in (0, 1):
        share = [x["test"] for x in got if x["label"] == label]
        assert abs(sum(share) / len(share) - 0.25) < 0.08
    few = spark.createDataFrame([(f"n{i}", 1, "f") for i in range(200)] + [("b", 0, None)] * 3, "domain string, label int, family string")
    split = domain_model.split_by_family(few).collect()
    assert 20 < sum(x["test"] for x in split if x["label"] == 1) < 80 and not any(x["test"] for x in split if x["label"] == 0)
