"""Threat rules over flow telemetry: each is a function from rows to emitted alerts, with a config of its own.

A rule has two steps.  Cheap window scalars gate the rows; what only evidence needs is computed for rows that pass.
Then score, severity and the cooldown fold follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taplight.functions import codes
from taplight.functions import rolling as roll
from taplight.functions.rolling import Rolling
from taplight.functions.windows import clamp, seconds, share, whole
from taplight.operators.emit import cooldown
from taplight.operators.enrich import look_back


def _scored(df: DataFrame, score: Column, keys: list[str], cooldown_us: int, arrival: str = "flow_id") -> DataFrame:
    """Score, severity and rank added; only rows that the cooldown lets through."""
    rated = df.withColumn("score", codes.normal_score(score))
    rated = rated.withColumn("severity", codes.severity(F.col("score")))
    rated = rated.withColumn("rank", codes.severity_rank(F.col("severity")))
    return cooldown(rated, keys, cooldown_us, arrival=arrival)


@dataclass(frozen=True)
class Flood:
    window_us: int = seconds(10)
    cooldown_us: int = seconds(60)
    sources: int = 50
    flows: int = 200
    packets: int = 1000

    def __call__(self, flows: DataFrame) -> DataFrame:
        """Many sources send many flows or packets to one destination."""
        window = Rolling(("dst",), self.window_us)
        seen = window.over(flows, {"sources": roll.distinct("src"), "flows": roll.count(), "packets": roll.total("orig_pkts"), "counted": roll.known("orig_pkts")})
        seen = seen.withColumn("packets", whole("packets", "counted", "flows"))
        fired = seen.where((F.col("sources") >= self.sources) & ((F.col("flows") >= self.flows) | F.coalesce(F.col("packets") >= self.packets, F.lit(False))))
        volume = F.greatest(F.col("flows") / self.flows, F.coalesce(F.col("packets") / self.packets, F.lit(0.0)))
        ratio = (F.col("sources") / self.sources + volume) / 2
        return _scored(fired, 0.5 + 0.5 * (ratio - 1) / 3, ["dst"], self.cooldown_us)


@dataclass(frozen=True)
class Scan:
    window_us: int = seconds(60)
    cooldown_us: int = seconds(300)
    ports: int = 15
    service_ports: int = 3
    last_service_port: int = 49151
    fanout: int = 20
    coverage: float = 0.5
    incomplete: float = 0.05
    answered: float = 0.20
    answer_bytes: int = 100

    def __call__(self, flows: DataFrame) -> DataFrame:
        """One source tries many ports, or one port on many hosts, and few of them answer."""
        endpoint = F.struct("dst", "port")
        known = codes.classified(F.col("state"))
        complete = F.col("state").isin(*codes.COMPLETE_STATES)
        answered = F.col("resp_bytes") >= self.answer_bytes
        of = lambda c: roll.distinct(F.when(c, endpoint))
        measures = {
            "ports": roll.distinct("port"),
            "service_ports": roll.distinct(F.when(F.col("port") <= self.last_service_port, F.col("port"))),
            "endpoints": roll.distinct(endpoint),
            "known": of(known),
            "complete": of(complete),
            "responded": of(answered),
            "fanout": roll.widest("port", "dst"),
        }
        seen = Rolling(("src",), self.window_us).over(flows, measures)
        seen = seen.withColumns({"coverage": share("known", "endpoints"), "incomplete": share(F.col("known") - F.col("complete"), "known"), "answered": share("responded", "endpoints")})
        quiet = F.when(F.col("coverage") >= self.coverage, F.coalesce(F.col("incomplete"), F.lit(0.0)) >= self.incomplete).otherwise(F.col("answered") <= self.answered)
        vertical = (F.col("ports") >= self.ports) & (F.col("service_ports") >= self.service_ports)
        horizontal = F.col("fanout") >= self.fanout
        fired = seen.where((vertical | horizontal) & quiet)
        ratio = F.greatest(F.when(vertical, F.col("ports") / self.ports).otherwise(0.0), F.when(horizontal, F.col("fanout") / self.fanout).otherwise(0.0))
        return _scored(fired, 0.5 + 0.5 * (ratio - 1) / 3 + F.when(vertical & horizontal, 0.10).otherwise(0.0), ["src"], self.cooldown_us)


@dataclass(frozen=True)
class Beacon:
    window_us: int = seconds(900)
    cooldown_us: int = seconds(300)
    contacts: int = 6
    least_s: float = 2.0
    most_s: float = 120.0
    variation: float = 0.20
    mean_bytes: int = 65_536
    # Ports of services that call on a timer and are no controllers.
    service_ports: tuple[int, ...] = (67, 68, 123, 137, 138, 389, 636, 1900, 3268, 3269, 5353, 5355)

    def candidates(self, flows: DataFrame) -> DataFrame:
        """Flows whose destination may be a controller: no service port, multicast or broadcast destination."""
        octet = F.regexp_extract("dst", r"^(\d{1,3})\.\d", 1).try_cast("int")
        never = F.coalesce(F.col("port").isin(*self.service_ports), F.lit(False)) | F.coalesce(octet.between(224, 239), F.lit(False)) | (F.col("dst") == "255.255.255.255") | F.lower("dst").rlike("^ff[0-9a-f]{2}:")
        return flows.where(~F.coalesce(never, F.lit(False)))

    def __call__(self, flows: DataFrame) -> DataFrame:
        """Contacts of one source and endpoint at steady intervals."""
        keys = ["src", "dst", "port", "proto"]
        measures = {"contacts": roll.count(), "gaps": roll.gaps(), "sent": roll.total("orig_bytes"), "sizes": roll.known("orig_bytes")}
        seen = Rolling(tuple(keys), self.window_us).over(self.candidates(flows), measures)
        n, gaps = F.col("gaps.n"), F.col("gaps")
        mean = roll.mean_gap_us(gaps)
        measured = seen.withColumns({"mean_sent": share("sent", "sizes"), "mean_gap": mean / 1e6, "cv": F.try_divide(roll.gap_deviation_us(gaps), mean)})
        enough = (F.col("contacts") >= self.contacts) & (n >= self.contacts - 1) & F.col("mean_gap").between(self.least_s, self.most_s)
        steady = measured.where(enough & (F.col("cv") <= self.variation) & (F.coalesce(F.col("mean_sent"), F.lit(0.0)) <= self.mean_bytes))
        strength = 0.6 * clamp(1 - F.col("cv") / self.variation) + 0.4 * clamp(((n + 1) / self.contacts - 1) / 3)
        return _scored(steady.withColumn("n_gaps", n), 0.5 + 0.5 * strength, keys, self.cooldown_us).drop("gaps")


@dataclass(frozen=True)
class Outbound:
    window_us: int = seconds(300)
    cooldown_us: int = seconds(300)
    concentration: float = 0.60
    total_bytes: int = 50 << 20
    rows: int = 10
    single_bytes: int = 100 << 20

    def __call__(self, flows: DataFrame) -> DataFrame:
        """Much data from one source to one destination, that makes up most of what the source sends."""
        sent = {"pair_rows": roll.count(), "pair_bytes": roll.total("orig_bytes"), "pair_known": roll.known("orig_bytes"), "largest": roll.largest("orig_bytes")}
        by_pair = Rolling(("src", "dst"), self.window_us).over(flows, sent)
        by_pair = by_pair.withColumns({c: whole(c, "pair_known", "pair_rows") for c in ("pair_bytes", "largest")})
        seen = Rolling(("src",), self.window_us).over(by_pair, {"source_bytes": roll.total("orig_bytes"), "source_known": roll.known("orig_bytes"), "source_rows": roll.count()})
        seen = seen.withColumn("source_bytes", whole("source_bytes", "source_known", "source_rows"))
        part = F.when(F.col("source_bytes") > 0, F.least(F.col("pair_bytes") / F.col("source_bytes"), F.lit(1.0))).when(F.col("source_bytes").isNotNull(), F.lit(0.0))
        seen = seen.withColumn("concentration", part)
        sustained = (F.col("pair_bytes") >= self.total_bytes) & (F.col("pair_rows") >= self.rows)
        single = F.col("largest") >= self.single_bytes
        fired = seen.where((F.col("concentration") >= self.concentration) & (F.coalesce(sustained, F.lit(False)) | F.coalesce(single, F.lit(False))))
        cap = lambda c: F.least(c, F.lit(4.0))
        ratio = F.greatest(F.when(sustained, (cap(F.col("pair_bytes") / self.total_bytes) + cap(F.col("pair_rows") / self.rows)) / 2).otherwise(0.0), F.when(single, cap(F.col("largest") / self.single_bytes)).otherwise(0.0))
        return _scored(fired, 0.5 + 0.5 * (ratio - 1) / 3 + 0.10 * clamp((F.col("concentration") - self.concentration) / (1 - self.concentration)), ["src", "dst"], self.cooldown_us)


@dataclass(frozen=True)
class DnsTunnel:
    window_us: int = seconds(300)
    cooldown_us: int = seconds(300)
    kept_rows: int = 5000
    rows: int = 20
    signals: int = 2
    suspicious: float = 0.5
    txt: float = 0.30
    length: int = 50
    entropy: float = 4.0
    subdomain_entropy: float = 3.5
    labels: int = 5

    def signal_count(self) -> Column:
        """How many of the name's measures are out of the ordinary; a missing measure never is."""
        tests = (F.col("query_length") >= self.length, F.col("query_entropy") >= self.entropy, F.col("subdomain_entropy") >= self.subdomain_entropy, F.col("label_count") >= self.labels, F.col("is_txt"))
        return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))

    def __call__(self, queries: DataFrame) -> DataFrame:
        """Names sent to one resolver that look like data: long, mixed, of many labels, or for text records."""
        keys = ["src", "resolver"]
        marked = queries.withColumn("signals", self.signal_count())
        odd = F.col("signals") >= self.signals
        measures = {"rows": roll.count(), "odd_rows": roll.rows_with(odd), "signal_sum": roll.total(F.when(odd, F.col("signals"))), "txt_rows": roll.rows_with(F.col("is_txt")), "typed": roll.known("is_txt")}
        seen = Rolling(tuple(keys), self.window_us, arrival="page_id").over(marked, measures, latest_rows=self.kept_rows).withColumn("txt_ratio", share("txt_rows", "typed"))
        fired = seen.where((F.col("rows") >= self.rows) & (F.col("odd_rows") / F.col("rows") >= self.suspicious))
        ratio, mean = F.col("odd_rows") / F.col("rows"), F.col("signal_sum") / F.col("odd_rows")
        strength = 0.5 * clamp((ratio - 0.5) / 0.5) + 0.25 * clamp((F.col("rows") / self.rows - 1) / 2) + 0.25 * clamp((mean - 2) / 3)
        return _scored(fired, 0.5 + 0.5 * strength + F.when(F.col("txt_ratio") >= self.txt, 0.10).otherwise(0.0), keys, self.cooldown_us, arrival="page_id")


@dataclass(frozen=True)
class TlsMetadata:
    window_us: int = seconds(300)
    cooldown_us: int = seconds(300)
    kept_rows: int = 5000
    rows: int = 6
    suspicious: float = 0.60
    sni_length: int = 38
    sni_entropy: float = 4.2
    obsolete: float = 0.50

    def __call__(self, handshakes: DataFrame) -> DataFrame:
        """Handshakes of one pair whose server names look generated; needs sni_length, sni_entropy and version."""
        keys = ["src", "dst"]
        odd = (F.col("sni_length") >= self.sni_length) & (F.col("sni_entropy") >= self.sni_entropy)
        measures = {"rows": roll.count(), "odd_rows": roll.rows_with(odd), "obsolete_rows": roll.rows_with(F.col("version").isin(*codes.OBSOLETE_TLS)), "versions": roll.known("version")}
        seen = Rolling(tuple(keys), self.window_us).over(handshakes, measures, latest_rows=self.kept_rows)
        seen = seen.withColumns({"odd_ratio": share("odd_rows", "rows"), "obsolete_ratio": share("obsolete_rows", "versions")})
        fired = seen.where((F.col("rows") >= self.rows) & (F.col("odd_ratio") >= self.suspicious))
        strength = 0.6 * clamp((F.col("odd_ratio") - 0.6) / 0.4) + 0.4 * clamp((F.col("rows") / self.rows - 1) / 2)
        return _scored(fired, 0.5 + 0.5 * strength + F.when(F.col("obsolete_ratio") >= self.obsolete, 0.10).otherwise(0.0), keys, self.cooldown_us)


def fingerprint_hits(handshakes: DataFrame, feed: DataFrame, cooldown_us: int = seconds(300), arrival: str = "flow_id") -> DataFrame:
    """One alert per fingerprint of a handshake that the feed (kind, value) lists; score 1, a cooldown per pair and value.

    The feed goes to the join as it is, deduplicated; Spark broadcasts it where its size allows.
    """
    listed = feed.select(F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("value")).alias("value")).distinct()
    tall = handshakes.unpivot([c for c in handshakes.columns if c not in ("ja3", "ja3s", "ja4")], ["ja3", "ja3s", "ja4"], "kind", "value").withColumn("value", F.lower(F.trim("value")))
    hits = tall.join(listed, ["kind", "value"], "left_semi")
    rated = hits.withColumns({"score": F.lit(1.0), "severity": F.lit("critical"), "rank": F.lit(3)})
    return cooldown(rated, ["src", "dst", "kind", "value"], cooldown_us, arrival=arrival)


def generated_domains(scored: DataFrame, threshold: float, cooldown_us: int = seconds(300), span_us: int = seconds(300)) -> DataFrame:
    """Reports of sources that look up generated names; ``scored`` has src, domain, ts_us, flow_id, model_score.

    A name's own cooldown advances even where its source's suppresses the report; a report lists the distinct names of
    the last span, the first ten in order.
    """
    hits = scored.where(F.col("model_score") >= threshold).withColumn("score", codes.normal_score(0.5 + 0.5 * (F.col("model_score") - threshold) / (1 - threshold)))
    hits = hits.withColumns({"severity": codes.severity(F.col("score")), "rank": codes.severity_rank(codes.severity(F.col("score")))})
    by_name = cooldown(hits, ["src", "domain"], cooldown_us)
    seen = Rolling(("src",), span_us).over(by_name, {"n_domains": roll.distinct("domain")})
    reports = cooldown(seen, ["src"], cooldown_us)
    # The names of a report are looked up for reports alone; of each the ten first are kept before they are put together.
    met = look_back(reports, by_name.select("src", "ts_us", "flow_id", "domain"), "src", span_us).select(F.col("report").alias("flow_id"), F.col("domain").alias("name")).distinct()
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("flow_id").orderBy("name"))).where("place <= 10")
    samples = first.groupBy("flow_id").agg(F.array_sort(F.collect_list("name")).alias("sample"))
    return reports.join(samples, "flow_id", "left")


def widest_ports(alerts: DataFrame, flows: DataFrame, window_us: int) -> DataFrame:
    """(flow_id, fanout, fanout_port): the port that reaches most hosts in the window of each alert, the lowest of equal ones."""
    met = look_back(alerts, flows.where("port is not null").select("src", "ts_us", "flow_id", "port", "dst"), "src", window_us)
    by_port = met.groupBy(F.col("report").alias("flow_id"), F.col("port").alias("o_port")).agg(F.count_distinct("dst").alias("n"))
    return by_port.groupBy("flow_id").agg(F.max("n").alias("fanout"), F.min_by("o_port", F.struct(-F.col("n"), "o_port")).alias("fanout_port"))


def scan_pattern(ports: Column, ips: Column) -> Column:
    return F.when((ports >= 50) & (ips <= 3), "vertical").when((ips >= 20) & (ports <= 5), "horizontal").when((ports >= 20) & (ips >= 20), "block").when(ports.isNull() | ips.isNull(), "unknown").otherwise("mixed")


def flood_signature(entropy: Column, syn_ratio: Column, amplification: Column) -> Column:
    base = F.when((entropy >= 6) & (syn_ratio >= 0.7), "spoofed").when(entropy < 3, "direct").otherwise("mixed")
    return F.when(amplification >= 5, "amplification").otherwise(base)


def skip_reason(detector: str, exported: Column, packets: Column) -> Column:
    """Why a rule doesn't see a row, null where it does: exported flows reach the flood rule alone, and with a packet count."""
    if detector != "flood":
        return F.when(exported, "exported flow")
    return F.when(exported & packets.isNull(), "no packet count")


def decisions(detectors: list[str], exported: Column, packets: Column) -> Column:
    """Each rule's decision on a row: run, or why not."""
    return F.create_map(*(x for d in detectors for x in (F.lit(d), F.coalesce(skip_reason(d, exported, packets), F.lit("run")))))
