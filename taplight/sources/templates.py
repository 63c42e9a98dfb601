"""The life of export templates: inserted, refreshed, replaced, expired, withdrawn, reset.

Each exporter has a registry of templates by (source, template).  Events pass in order: a template is inserted, or
refreshes an equal one, or replaces another under the next generation; a broken one withdraws what it would have
replaced; a reset forgets all that the exporter has; data look a template up.  A template lives ``ttl_s`` from when it
was last sent and is gone at that second.  Each source has a clock, which stands while it has a template: what comes
from before it changes nothing and is read by nothing.

An exporter's events have to pass in order, so they are one task's; what is kept is bounded by MOST templates.  The
batch fold and the stream run the same steps, so their rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# A template's life in seconds, how many an exporter may have, fields of a template.
TTL_S, MOST, MOST_FIELDS = 1800, 4096, 256
DEFINES, WITHDRAWS, RESETS = ("template", "options"), "withdraw", "reset"
ADDED = "action string, generation long, pruned int, definition string"

Entry = list[Any]  # definition, generation, gone at


class Registry:
    """Templates of one exporter: (source, template) -> definition, generation, second at which it is gone."""

    def __init__(self, ttl_s: int = TTL_S, most: int = MOST, entries: dict[tuple[int, int], Entry] | None = None, clocks: dict[int, int] | None = None) -> None:
        self.ttl_s, self.most = ttl_s, most
        self.entries, self.clocks = entries or {}, clocks or {}

    def _settle(self, source: int, at: int) -> None:
        """A source's clock stands at ``at`` while it has a template."""
        if any(s == source for s, _ in self.entries):
            self.clocks[source] = at
        else:
            self.clocks.pop(source, None)

    def apply(self, kind: str, source: int, template: int | None, definition: str | None, at: int) -> tuple[str, int | None, int, str | None]:
        """(action, generation, templates that were gone and are forgotten now, definition that data are read by)."""
        if kind == RESETS:
            gone = len(self.entries)
            self.entries.clear()
            self.clocks.clear()
            return "reset", None, gone, None
        if at < self.clocks.get(source, at):
            return "clock", None, 0, None
        key = (source, template)
        held = self.entries.get(key)
        if kind in DEFINES:
            alive = held if held and held[2] > at else None
            if not alive and sum(s != source or e[2] > at for (s, _), e in self.entries.items()) >= self.most:
                return "full", None, 0, None
            old = [k for k, e in self.entries.items() if k[0] == source and e[2] <= at]
            for k in old:
                del self.entries[k]
            action = "inserted" if not alive else "refreshed" if alive[0] == definition else "replaced"
            generation = 1 if not alive else alive[1] + (action == "replaced")
            self.entries[key] = [definition, generation, at + self.ttl_s]
            self.clocks[source] = at
            return action, generation, len(old), None
        if held and (kind == WITHDRAWS or held[2] <= at):
            del self.entries[key]
        self._settle(source, at)
        if not held:
            return "unknown", None, 0, None
        if held[2] <= at:
            return "expired", held[1], 0, None
        return ("withdrawn", held[1], 0, None) if kind == WITHDRAWS else ("found", held[1], 0, held[0])


def transitions(events: DataFrame, order: list[str], exporter: str = "exporter", ttl_s: int = TTL_S, most: int = MOST) -> DataFrame:
    """``events`` (source_id, kind, template_id, definition, export_s) with what each did; ``definition`` becomes what data are read by."""
    first = F.row_number().over(Window.partitionBy(exporter).orderBy(*order)) == 1
    rows = events.withColumnRenamed("definition", "t__defined").withColumn("t__first", first).sortWithinPartitions(exporter, *order)
    own = [c for c in events.columns if c != "definition"]
    schema = StructType([f for f in events.schema if f.name != "definition"] + StructType.fromDDL(ADDED).fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(ttl_s, most)
        for batch in batches:
            out = []
            for new, *event in zip(*(batch.column(c).to_pylist() for c in ("t__first", "kind", "source_id", "template_id", "t__defined", "export_s")), strict=True):
                if new:
                    registry = Registry(ttl_s, most)
                out.append(registry.apply(*event))
            made = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *made], schema.fieldNames())

    return rows.mapInArrow(fold, schema)


class _Live(StatefulProcessor):
    """A registry per exporter in map state; an exporter of which nothing came for IDLE lives is forgotten by a timer."""

    def __init__(self, order: list[str], columns: list[str], ttl_s: int, most: int, idle_ms: int) -> None:
        self.order, self.columns, self.ttl_s, self.most, self.idle_ms = order, columns, ttl_s, most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("templates", "source long, template int", "definition string, generation long, gone long")
        self.clocks = handle.getMapState("clocks", "source long", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {k: list(v) for k, v in self.kept.iterator()}
        clocks = {k[0]: v[0] for k, v in self.clocks.iterator()}
        registry = Registry(self.ttl_s, self.most, {k: list(v) for k, v in before.items()}, dict(clocks))
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        none = lambda v: None if pd.isna(v) else v
        out = [registry.apply(k, int(s), None if pd.isna(t) else int(t), none(d), int(at)) for k, s, t, d, at in zip(*(frame[c] for c in ("kind", "source_id", "template_id", "definition", "export_s")), strict=True)]
        for k in before.keys() - registry.entries.keys():
            self.kept.removeKey(k)
        for k, e in registry.entries.items():
            if before.get(k) != e:
                self.kept.updateValue(k, tuple(e))
        for s in clocks.keys() - registry.clocks.keys():
            self.clocks.removeKey((s,))
        for s, at in registry.clocks.items():
            self.clocks.updateValue((s,), (at,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if registry.entries:
            self.handle.registerTimer(max(e[2] for e in registry.entries.values()) * 1000 + self.idle_ms)
        made = pd.DataFrame(out, columns=[p.split()[0] for p in ADDED.split(", ")], index=frame.index)
        made["generation"] = made["generation"].astype("Int64")
        yield pd.concat([frame[self.columns], made], axis=1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.clocks.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_transitions(events: DataFrame, order: list[str], ts: str, exporter: str = "exporter", delay: str = "10 minutes", ttl_s: int = TTL_S, most: int = MOST, idle_s: int = TTL_S) -> DataFrame:
    """``transitions`` of a stream of events in order; ``ts`` is their time, whose watermark lets idle exporters go."""
    own = [f for f in events.schema if f.name not in ("definition", ts)]
    schema = StructType(own + StructType.fromDDL(ADDED).fields)
    processor = _Live(order, [f.name for f in own], ttl_s, most, idle_s * 1000)
    return events.withWatermark(ts, delay).groupBy(exporter).transformWithStateInPandas(processor, schema, "Append", "EventTime")
