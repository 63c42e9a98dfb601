"""Folds over each key's rows in event-time order, on streams whose rows come out of order.

A key has a clock: the latest time that came, less a delay.  Rows wait in keyed state, each under its time, until the
clock has passed them, and are then folded in order; a row that comes when the clock has passed its time is too late and
goes to the output as such, unfolded.  All rows of a micro-batch are judged by the clock as it stood before.  A row
without an identifier is a heartbeat: it moves the clock and nothing else, so a quiet key can be told that time goes on.
State is bounded by the rows of the delay and of the fold's own window, and goes when a key is idle.

A fold keeps what it needs as plain values, which the state holds as JSON, so that a restart goes on where it stopped.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator
from math import floor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegralType, StructField, StructType

from taplight.functions.codes import COMPLETE_STATES, INCOMPLETE_STATES, SEVERITY_FROM
from taplight.operators.detectors import Flood, Scan
from taplight.operators.emit import Finding


class Fold(Protocol):
    """What is kept of a key's rows; ``load`` gets what ``dump`` gave, or None."""

    def load(self, kept: list | None) -> None: ...

    def dump(self) -> list: ...

    def step(self, row: dict[str, Any]) -> dict[str, Any] | None:
        """The values that a row adds, or None if it isn't emitted."""


class _Ordered(StatefulProcessor):
    def __init__(self, make: Callable[[], Fold], columns: list[str], added: list[str], ts: str, arrival: str, delay_us: int, idle_ms: int, whole: set[str]) -> None:
        self.make, self.columns, self.added, self.whole = make, columns, added, whole
        self.ts, self.arrival, self.delay_us, self.idle_ms = ts, arrival, delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, arrival long", "row string")
        self.kept = handle.getValueState("kept", "clock long, fold string")

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.columns, *self.added, "late"], dtype=object)

    def _values(self, frame: pd.DataFrame, name: str) -> list:
        """A column's plain values: none for nulls, for which Spark makes whole numbers floats."""
        column = frame[name]
        if not column.hasnans:
            return column.tolist()
        return [None if gone else int(v) if name in self.whole else v for v, gone in zip(column.tolist(), column.isna(), strict=True)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        clock, folded = before, _ = self.kept.get() or (None, None)
        place, seq = self.columns.index(self.ts), self.columns.index(self.arrival)
        out: list[tuple] = []
        top = None
        fresh: dict[tuple[int, int], tuple] = {}
        for frame in rows:
            for values in zip(*(self._values(frame, c) for c in self.columns), strict=True):
                at = values[place]
                top = at if top is None else max(top, at)
                if values[seq] is None:
                    continue
                if clock is not None and at <= clock:
                    out.append((*values, *[None] * len(self.added), True))
                else:
                    fresh[at, values[seq]] = values
        clock = max(x for x in (clock, None if top is None else top - self.delay_us) if x is not None)
        due = {k: v for k, v in fresh.items() if k[0] <= clock}
        for k, v in fresh.items():
            if k not in due:
                self.waiting.updateValue(k, (json.dumps(v),))
        for k, v in list(self.waiting.iterator()):
            if k[0] <= clock:
                due[tuple(k)] = json.loads(v[0])
                self.waiting.removeKey(k)
        fold = self.make()
        fold.load(json.loads(folded) if folded else None)
        for k in sorted(due):
            if (added := fold.step(dict(zip(self.columns, due[k], strict=True)))) is not None:
                out.append((*due[k], *(added[c] for c in self.added), False))
        self.kept.update((clock, json.dumps(fold.dump())))
        if clock != before:
            if before is not None:
                self.handle.deleteTimer(self._idle(before))
            self.handle.registerTimer(self._idle(clock))
        yield from self._out(out)

    def _idle(self, clock: int) -> int:
        """When a key with such a clock is idle; the one timer that it has."""
        return (clock + self.delay_us) // 1000 + self.idle_ms

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """An idle key: what still waits is folded, and the key is forgotten."""
        _, folded = self.kept.get()
        fold, out = self.make(), []
        fold.load(json.loads(folded) if folded else None)
        for _, values in sorted((tuple(k), json.loads(v[0])) for k, v in self.waiting.iterator()):
            if (added := fold.step(dict(zip(self.columns, values, strict=True)))) is not None:
                out.append((*values, *(added[c] for c in self.added), False))
        self.waiting.clear()
        self.kept.clear()
        yield from self._out(out)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], make: Callable[[], Fold], added: str, delay_us: int, ts: str = "ts_us", arrival: str = "flow_id", idle_s: int = 30 * 86_400) -> DataFrame:
    """``rows`` that their key's fold emits, with the columns that it adds (DDL), and those that came too late (``late``).

    A key is idle when the stream is ``idle_s`` past it, which is also how far behind the stream Spark takes rows at all.
    """
    if idle_s * 1_000_000 <= delay_us:
        raise ValueError("a key may not be idle before its rows are due")
    more = StructType.fromDDL(added)
    processor = _Ordered(make, rows.columns, more.fieldNames(), ts, arrival, delay_us, idle_s * 1000, {f.name for f in rows.schema.fields if isinstance(f.dataType, IntegralType)})
    schema = StructType([*rows.schema.fields, *more.fields, StructField("late", BooleanType())])
    timed = rows.withColumn("o__time", F.timestamp_micros(ts)).withWatermark("o__time", f"{idle_s} seconds")
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Places:
    """Numbers a key's rows in their order."""

    def load(self, kept: list | None) -> None:
        self.n = kept[0] if kept else 0

    def dump(self) -> list:
        return [self.n]

    def step(self, row: dict[str, Any]) -> dict[str, Any]:
        self.n += 1
        return {"place": self.n}


class Findings:
    """Alerts folded into findings: when each began, and whether the alert counts or was sent again."""

    def __init__(self, gap_us: int, ts: str = "ts_us", arrival: str = "alert_id") -> None:
        self.gap_us, self.ts, self.arrival = gap_us, ts, arrival

    def load(self, kept: list | None) -> None:
        self.finding = Finding(self.gap_us, *(kept or []))

    def dump(self) -> list:
        return [self.finding.begin, self.finding.last, self.finding.ids]

    def step(self, row: dict[str, Any]) -> dict[str, Any]:
        begin, counts = self.finding.observe(row[self.ts], row[self.arrival])
        return {"finding_us": begin, "counts": counts}


class _Rule:
    """A window of a key's rows whose measures follow as rows enter and leave, then score, severity and cooldown."""

    fields: tuple[str, ...] = ()

    def __init__(self, rule: Any) -> None:
        self.rule = rule

    def load(self, kept: list | None) -> None:
        rows, self.last, self.top = kept or ([], None, None)
        self.rows: deque[tuple] = deque()
        self.open()
        for r in rows:
            self.enter(*r[1:])
            self.rows.append(tuple(r))

    def dump(self) -> list:
        return [list(self.rows), self.last, self.top]

    def open(self) -> None: ...

    def enter(self, *values: Any) -> None: ...

    def leave(self, *values: Any) -> None: ...

    def scored(self) -> tuple[float, dict[str, Any]] | None: ...

    def step(self, row: dict[str, Any]) -> dict[str, Any] | None:
        at, values = row["ts_us"], [row[f] for f in self.fields]
        while self.rows and self.rows[0][0] <= at - self.rule.window_us:
            self.leave(*self.rows.popleft()[1:])
        self.rows.append((at, *values))
        self.enter(*values)
        found = self.scored()
        if found is None:
            return None
        score = floor(min(max(found[0], 0.0), 1.0) * 1e6 + 0.5) / 1e6
        levels = sorted(SEVERITY_FROM.values())
        rank = bisect_right(levels, score)
        if self.last is not None and at - self.last < self.rule.cooldown_us and rank <= self.top:
            return None
        self.last, self.top = at, rank
        names = {v: k for k, v in SEVERITY_FROM.items()}
        return {"score": score, "severity": names[levels[rank - 1]] if rank else "low", **found[1]}


def _more(counts: Counter, value: Any, n: int) -> None:
    counts[value] += n
    if not counts[value]:
        del counts[value]


class FloodFold(_Rule):
    """``Flood`` of a destination, row by row."""

    fields = ("src", "orig_pkts")
    rule: Flood

    def open(self) -> None:
        self.sources: Counter = Counter()
        self.packets = self.counted = 0

    def _count(self, src: str | None, packets: int | None, n: int) -> None:
        if src is not None:
            _more(self.sources, src, n)
        if packets is not None:
            self.packets += n * packets
            self.counted += n

    def enter(self, *values: Any) -> None:
        self._count(*values, 1)

    def leave(self, *values: Any) -> None:
        self._count(*values, -1)

    def scored(self) -> tuple[float, dict[str, Any]] | None:
        r, sources, flows = self.rule, len(self.sources), len(self.rows)
        packets = self.packets if self.counted == flows else None
        if sources < r.sources or not (flows >= r.flows or (packets is not None and packets >= r.packets)):
            return None
        ratio = (sources / r.sources + max(flows / r.flows, 0.0 if packets is None else packets / r.packets)) / 2
        return 0.5 + 0.5 * (ratio - 1) / 3, {"sources": sources, "flows": flows}


class ScanFold(_Rule):
    """``Scan`` of a source, row by row."""

    fields = ("dst", "port", "state", "resp_bytes")
    rule: Scan

    def open(self) -> None:
        self.ports, self.ends, self.known, self.complete, self.answered = (Counter() for _ in range(5))
        self.hosts: dict[Any, Counter] = {}
        self.widths: Counter = Counter()

    def _count(self, dst: Any, port: Any, state: Any, answer: Any, n: int) -> None:
        end = (dst, port)
        for counts, holds in ((self.ends, True), (self.known, state in COMPLETE_STATES or state in INCOMPLETE_STATES), (self.complete, state in COMPLETE_STATES), (self.answered, answer is not None and answer >= self.rule.answer_bytes)):
            if holds:
                _more(counts, end, n)
        if port is not None:
            _more(self.ports, port, n)
            hosts = self.hosts.setdefault(port, Counter())
            before = len(hosts)
            _more(hosts, dst, n)
            if before != len(hosts):
                _more(self.widths, before, -1) if before else None
                _more(self.widths, len(hosts), 1) if hosts else self.hosts.pop(port)

    def enter(self, *values: Any) -> None:
        self._count(*values, 1)

    def leave(self, *values: Any) -> None:
        self._count(*values, -1)

    def scored(self) -> tuple[float, dict[str, Any]] | None:
        r = self.rule
        ports, fanout = len(self.ports), max(self.widths, default=0)
        vertical = ports >= r.ports and sum(p <= r.last_service_port for p in self.ports) >= r.service_ports
        horizontal = fanout >= r.fanout
        ends, known = len(self.ends), len(self.known)
        if known / ends >= r.coverage:
            quiet = ((known - len(self.complete)) / known if known else 0.0) >= r.incomplete
        else:
            quiet = len(self.answered) / ends <= r.answered
        if not (vertical or horizontal) or not quiet:
            return None
        ratio = max(ports / r.ports if vertical else 0.0, fanout / r.fanout if horizontal else 0.0)
        return 0.5 + 0.5 * (ratio - 1) / 3 + (0.10 if vertical and horizontal else 0.0), {"ports": ports, "fanout": fanout}
