"""Alerts: checks, keys, filters, pages, host views and evidence rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AlertFilter:
    """Conditions that all must hold; None is no condition."""

    from_us: int | None = None
    to_us: int | None = None
    threat_class: str | None = None
    severity: str | None = None
    src: str | None = None
    dst: str | None = None
    host: str | None = None
    detector: str | None = None
    incident_id: str | None = None
    min_score: float | None = None

    def condition(self) -> Column:
        tests = [F.lit(True)]
        if self.from_us is not None:
            tests.append(F.col("ts_us") >= self.from_us)
        if self.to_us is not None:
            tests.append(F.col("ts_us") <= self.to_us)
        tests += [F.col(c) == v for c in ("threat_class", "severity", "src", "dst", "detector", "incident_id") if (v := getattr(self, c)) is not None]
        if self.host is not None:
            tests.append((F.col("src") == self.host) | (F.col("dst") == self.host))
        if self.min_score is not None:
            tests.append(F.col("score") >= self.min_score)
        return reduce(lambda a, b: a & b, tests)


def page(alerts: DataFrame, chosen: AlertFilter, limit: int, offset: int = 0) -> DataFrame:
    """The latest alerts that pass, with the number of all that pass; ties by identifier."""
    passed = alerts.where(chosen.condition())
    total = passed.agg(F.count(F.lit(1)).alias("total"))
    return passed.orderBy(F.desc("ts_us"), F.desc("alert_id")).offset(offset).limit(limit).join(F.broadcast(total))


def dedup_key() -> Column:
    """The first 32 hex digits of a SHA-1 over class, scope, entity and detector; the entity depends on the scope."""
    entity = F.when(F.col("scope") == "destination", F.concat_ws(":", "dst", "port")).when(F.col("scope") == "pair", F.concat_ws(">", "src", "dst")).otherwise(F.col("src"))
    return F.substring(F.sha1(F.concat_ws("|", "threat_class", "scope", entity, "detector").cast("binary")), 1, 32)


def pivot_host() -> Column:
    """The host that an incident is about: the target of a flood or of a destination's alert, else the source."""
    towards = F.when((F.col("threat_class") == "ddos") | (F.col("scope") == "destination"), F.coalesce("dst", "src"))
    return F.coalesce(towards, F.col("src"), F.col("dst"))


def reject_reasons() -> Column:
    """Why a row breaks the alert contract; empty for a good one."""
    tests = {
        "version": F.col("schema_version") != "1.1",
        "protocol": F.col("protocol") != F.lower("protocol"),
        "score": ~F.col("score").between(0, 1) | F.isnan("score"),
        "order": F.col("event_end_us") < F.col("event_start_us"),
        "detected": F.col("detected_us") < F.col("event_start_us"),
        "flow_id": (F.col("scope") == "flow") & F.col("flow_id").isNull(),
        "evidence": F.coalesce(F.size("evidence"), F.lit(0)) == 0,
    }
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in tests.items())), lambda x: x.isNotNull())


def by_role(alerts: DataFrame) -> DataFrame:
    """Each alert once per end, with its peer."""
    ends = F.array(F.struct(F.col("src").alias("host"), F.col("dst").alias("peer"), F.lit("src").alias("role")), F.struct(F.col("dst").alias("host"), F.col("src").alias("peer"), F.lit("dst").alias("role")))
    return alerts.withColumn("end", F.explode(ends)).select("*", "end.*").drop("end").where("host is not null")


def host_rollup(alerts: DataFrame) -> DataFrame:
    return by_role(alerts).groupBy("host").agg(F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"), F.count(F.lit(1)).alias("n"))


def recent(alerts: DataFrame, what: str, n: int) -> DataFrame:
    """What each host was seen with, by the time it was last seen, the latest ``n``; rows without it don't count."""
    seen = by_role(alerts).where(F.col(what).isNotNull()).groupBy("host", what).agg(F.max("ts_us").alias("last_seen"), F.count(F.lit(1)).alias("alerts"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("last_seen"), what))
    return seen.withColumn("place", place).where(F.col("place") <= n)


def recent_peers(alerts: DataFrame, n: int) -> DataFrame:
    return recent(alerts, "peer", n)


def evidence_rows(alerts: DataFrame, registry: DataFrame) -> DataFrame:
    """A row per evidence key (map<string,double>) that has a threshold: in the registry, or as ``<key>_threshold`` of its own.

    ``registry`` is (threat_class, feature, threshold, above).
    """
    tall = alerts.select("alert_id", "threat_class", "evidence", F.explode("evidence").alias("feature", "value")).where(~F.col("feature").endswith("_threshold"))
    own = F.try_element_at("evidence", F.concat("feature", F.lit("_threshold")))
    joined = tall.withColumn("own", own).join(registry, ["threat_class", "feature"], "left")
    rows = joined.withColumns({"threshold": F.coalesce("own", "threshold"), "above": F.coalesce("above", F.lit(True))}).where("threshold is not null")
    exceeded = F.when(F.col("above"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.withColumn("exceeded", exceeded).select("alert_id", "feature", "value", "threshold", "above", "exceeded", F.greatest(F.col("value"), F.col("threshold") * 1.25).alias("scale"))


def renamed_evidence(aliases: dict[str, str]) -> Column:
    """The evidence map with keys renamed; where the new name is there already, the old one stays."""
    keys = F.map_keys("evidence")
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.transform_keys("evidence", lambda k, _: F.when(~F.array_contains(keys, F.coalesce(F.try_element_at(table, k), k)), F.coalesce(F.try_element_at(table, k), k)).otherwise(k))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The store after new rows: counts, last seen and evidence replaced, the best score kept, the incident once known."""
    both = stored.withColumn("newer", F.lit(0)).unionByName(new.withColumn("newer", F.lit(1)))
    at = F.struct("newer", "last_seen")
    return both.groupBy("alert_id").agg(F.max_by("occurrences", at).alias("occurrences"), F.max_by("last_seen", at).alias("last_seen"), F.max("score").alias("score"), F.coalesce(F.max_by(F.col("incident_id"), F.when(F.col("incident_id").isNotNull(), at)), F.lit(None)).alias("incident_id"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between a key's least and greatest value, the last closed; one bin if they agree."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.when(F.col("hi") - F.col("lo") < 1e-9, 0).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1)))
    return df.join(edges, keys).withColumn("bin", bin_no.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def project(alerts: DataFrame, folded: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Each alert as it is shown: under the identity, window, count and best score of the run of repeats it is in.

    ``folded`` is what folding repeats gives (key, first_id, occurrences, first_seen, last_seen, max_score); times in
    microseconds, latencies in milliseconds with three decimals.
    """
    ms = lambda a, b: F.round((F.col(a) - F.col(b)) / 1000.0, 3)
    runs = folded.select(F.col(key).alias("run__key"), "first_id", "occurrences", "first_seen", "last_seen", "max_score")
    met = alerts.join(runs, F.col(key).eqNullSafe(F.col("run__key")) & F.col("ts_us").between(F.col("first_seen"), F.col("last_seen")))
    latencies = {"detector_latency_ms": ms("detected_us", "event_end_us"), "transport_latency_ms": ms("ingested_us", "detected_us"), "pipeline_latency_ms": ms("ingested_us", "event_end_us")}
    return met.withColumns({**latencies, "received_id": F.col("alert_id"), "alert_id": F.col("first_id"), "score": F.col("max_score")}).drop("run__key", "first_id", "max_score")


def bulk_report(rows: DataFrame, index: str, most: int = 25, fields: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts of accepted and rejected rows, the first rejected ones with some of their reasons each)."""
    checked = rows.withColumn("reasons", reject_reasons())
    bad = F.size("reasons") > 0
    counts = checked.agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    return counts, checked.where(bad).orderBy(index).limit(most).select(index, F.slice("reasons", 1, fields).alias("errors"))


def incident_list(incidents: DataFrame, limit: int, *, from_us: int | None = None, to_us: int | None = None, host: str | None = None, rank: int | None = None) -> DataFrame:
    """The incidents updated last that pass, of the 4 * limit updated last; ``total`` counts all of those that pass."""
    latest = incidents.orderBy(F.desc("updated_us"), "host").limit(4 * limit)
    tests = [F.lit(True)]
    if from_us is not None:
        tests.append(F.col("updated_us") >= from_us)
    if to_us is not None:
        tests.append(F.col("opened_us") <= to_us)
    if host is not None:
        tests.append(F.col("host") == host)
    if rank is not None:
        tests.append(F.col("rank") == rank)
    passed = latest.where(reduce(lambda a, b: a & b, tests))
    total = passed.agg(F.count(F.lit(1)).alias("total"))
    return passed.orderBy(F.desc("updated_us"), "host").limit(limit).join(F.broadcast(total))


def incident_members(alerts: DataFrame, keys: list[str], stage: str, most: int = 40) -> DataFrame:
    """The ``most`` latest alerts of each incident, placed by stage and time; what is told of an incident's classes is
    told of these."""
    latest = Window.partitionBy(*keys).orderBy(F.desc("ts_us"), F.desc("alert_id"))
    told = Window.partitionBy(*keys).orderBy(stage, "ts_us", "alert_id")
    kept = alerts.withColumn("member__no", F.row_number().over(latest)).where(F.col("member__no") <= most).drop("member__no")
    return kept.withColumn("place", F.row_number().over(told))


def stream_groups(alerts: DataFrame, incident: str = "incident_id") -> DataFrame:
    """Alerts as a stream shows them: one row per incident with several alerts, one per alert that is alone.

    ``rank`` is the worst, ``codes`` are the distinct ones in order of time, ``label`` is the source that all share.
    """
    key = F.coalesce(F.col(incident), F.concat(F.lit("alert "), F.col("alert_id").cast("string")))
    first = alerts.groupBy(key.alias("key"), "code").agg(F.min(F.struct("ts_us", "alert_id")).alias("at"), F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"), F.max("ts_us").alias("latest"), F.min("src").alias("low"), F.max("src").alias("high"), F.count("src").alias("named"))
    rows = first.groupBy("key").agg(F.sum("n").alias("shown"), F.max("rank").alias("rank"), F.max("latest").alias("latest"), F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("named").alias("named"))
    label = F.when((F.col("low") == F.col("high")) & (F.col("named") == F.col("shown")), F.col("low")).otherwise(F.col("key"))
    return rows.withColumns({"kind": F.when(F.col("shown") > 1, "group").otherwise("alert"), "label": label}).drop("low", "high", "named")


def detector_status(alerts: DataFrame, now_us: int, stale_us: int = 120_000_000) -> DataFrame:
    """Each detector's state by when it was last seen, its alerts, classes and mean latency."""
    seen = alerts.groupBy("detector").agg(F.count(F.lit(1)).alias("alerts"), F.max("ts_us").alias("last_seen"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"), F.array_sort(F.collect_set("threat_class")).alias("classes"))
    return seen.withColumn("state", F.when(now_us - F.col("last_seen") <= stale_us, "online").otherwise("degraded"))


def length_histogram(df: DataFrame, keys: list[str], length: str, width: int = 10) -> DataFrame:
    """Counts of lengths in bins of a width."""
    return df.where(F.col(length).isNotNull()).groupBy(*keys, (F.floor(F.col(length) / width) * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def peak_rate(df: DataFrame, keys: list[str], ts_us: str = "ts_us") -> DataFrame:
    """The most rows that fall into one second of each key."""
    return df.groupBy(*keys, F.floor(F.col(ts_us) / 1_000_000).alias("second")).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("peak"))


def fingerprint_feed(lines: DataFrame) -> DataFrame:
    """(kind, value, reason) of a feed's lines: ``kind:value``, or a bare digest, which is a ja3; comments and blanks go.

    A line that can't be used has a reason; values are trimmed and in lower case, each once.
    """
    line = F.trim("value")
    kind = F.when(line.contains(":"), F.lower(F.trim(F.substring_index(line, ":", 1)))).otherwise("ja3")
    value = F.lower(F.trim(F.when(line.contains(":"), F.expr("substring(trim(value), locate(':', trim(value)) + 1)")).otherwise(line)))
    digest, token = value.rlike("^[0-9a-f]{32}$"), value.rlike(r"^[a-z0-9_.\-]{4,128}$")
    reason = F.when(~kind.isin("ja3", "ja3s", "ja4"), "kind").when(value == "", "empty").when(kind.isin("ja3", "ja3s") & ~digest, "digest").when((kind == "ja4") & ~token, "token")
    return lines.where((line != "") & ~line.startswith("#")).select(kind.alias("kind"), value.alias("value"), reason.alias("reason")).distinct()


def alert_capture(lines: DataFrame) -> DataFrame:
    """Alerts of a capture's lines in order of detection: comments and lines that are no JSON objects are skipped."""
    line = F.trim("value")
    json = F.try_parse_json(line)
    good = lines.where((line != "") & ~line.startswith("//")).where(F.schema_of_variant(json).startswith("OBJECT"))
    return good.select(F.coalesce(F.try_variant_get(F.try_parse_json(F.trim("value")), "$.detected_at", "string"), F.lit("")).alias("detected_at"), F.trim("value").alias("alert")).orderBy("detected_at", "alert")


def fingerprints(*feeds: DataFrame) -> DataFrame:
    """The usable (kind, value) pairs of several feeds, each once."""
    return reduce(DataFrame.union, (f.where("reason is null").select("kind", "value") for f in feeds)).distinct()


def incident_notices(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What is new of incidents: created ones, and those whose number of alerts or rank changed."""
    old = before.select(*(F.col(k).alias(f"old_{k}") for k in keys), F.col("n_alerts").alias("old_n"), F.col("rank").alias("old_rank"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys))
    met = after.join(old, same, "left")
    notice = F.when(F.col("old_n").isNull(), "created").when((F.col("old_n") != F.col("n_alerts")) | (F.col("old_rank") != F.col("rank")), "updated")
    return met.withColumn("notice", notice).where("notice is not null").drop(*(f"old_{k}" for k in keys), "old_n", "old_rank")
