"""Public flow datasets in the shape of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_time(raw: Column) -> tuple[Column, Column]:
    """Day-first times with or without seconds, in UTC, and whether there were seconds; null for other texts."""
    text = F.trim(raw)
    exact = F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm:ss"))
    return F.coalesce(exact, F.try_to_timestamp(text, F.lit("d/M/yyyy H:mm"))), exact.isNotNull()


def convert(rows: DataFrame, time: str, columns: dict[str, str], classes: dict[str, str], label: str, benign: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a readable time in order, those of one time by ``ties``: counters below zero are 0, labels become classes or out of scope."""
    at, seconds = label_time(F.col(time))
    table = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)) if classes else F.expr("cast(map() as map<string,string>)")
    named = {name: F.greatest(F.col(source), F.lit(0)) for name, source in columns.items()}
    threat = F.try_element_at(table, F.col(label))
    out = rows.withColumns({**named, "event_time": at, "had_seconds": seconds, "threat_class": threat, "benign": F.col(label) == benign, "in_scope": threat.isNotNull()})
    return out.where("event_time is not null").orderBy("event_time", *ties)
