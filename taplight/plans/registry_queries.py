"""The life of export templates, in batch and on a stream, against SQL that steps through the events of each exporter."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.plans.catalog import query
from taplight.sources import shared, templates, views
from taplight.sources.views import FLOWS_SQL
from taplight.streaming import live

TTL_S = 43_200
#: Events as columns that Spark and DuckDB name alike; every 31st comes from a clock that went back.
_EVENTS = """SELECT flow_id, ts_us, concat('e', user_id % 40) AS exporter, k % 2 AS source_id, CAST(256 + k {div} 2 % 2 AS INT) AS template_id,
    CASE WHEN k % 20 < 6 THEN 'template' WHEN k % 20 = 6 THEN 'withdraw' WHEN k % 60 = 7 THEN 'reset' ELSE 'data' END AS kind,
    CASE WHEN k % 20 < 6 THEN concat('d', k {div} 4 % 3) END AS definition, ts_us {div} 1000000 - CASE WHEN k % 31 = 0 THEN 200000 ELSE 0 END AS export_s FROM {flows}"""

TRANSITIONS_SQL = f"""WITH RECURSIVE f AS ({FLOWS_SQL}), v AS ({_EVENTS.format(div="//", flows="f")}), ev AS (SELECT *, row_number() OVER (PARTITION BY exporter ORDER BY ts_us, flow_id) AS n, 1 + source_id * 2 + template_id - 256 AS i FROM v),
st AS (
    SELECT exporter, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS flow_id, CAST([NULL, NULL, NULL, NULL] AS VARCHAR[]) AS defs, CAST([NULL, NULL, NULL, NULL] AS BIGINT[]) AS gens, CAST([NULL, NULL, NULL, NULL] AS BIGINT[]) AS gones, CAST([NULL, NULL] AS BIGINT[]) AS clocks,
        CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS generation, CAST(NULL AS BIGINT) AS pruned, CAST(NULL AS VARCHAR) AS definition FROM (SELECT DISTINCT exporter FROM ev)
    UNION ALL
    SELECT exporter, n, flow_id, defs, gens, gones,
        CASE WHEN kind = 'reset' THEN [NULL, NULL] ELSE list_transform(range(1, 3), lambda j: CASE WHEN back OR j <> source_id + 1 THEN clocks[j] WHEN gens[source_id * 2 + 1] IS NOT NULL OR gens[source_id * 2 + 2] IS NOT NULL THEN export_s END) END,
        CASE WHEN kind = 'reset' THEN 'reset' WHEN back THEN 'clock' WHEN kind = 'template' THEN CASE WHEN NOT alive THEN 'inserted' WHEN held_def = def THEN 'refreshed' ELSE 'replaced' END WHEN held_gen IS NULL THEN 'unknown' WHEN NOT alive THEN 'expired' WHEN kind = 'withdraw' THEN 'withdrawn' ELSE 'found' END,
        CASE WHEN kind = 'reset' OR back THEN NULL WHEN kind = 'template' THEN new_gen ELSE held_gen END,
        CASE WHEN kind = 'reset' THEN held WHEN back OR kind <> 'template' THEN 0 ELSE old END,
        CASE WHEN kind = 'data' AND NOT back AND alive THEN held_def END
    FROM (SELECT * EXCLUDE (defs, gens, gones),
            list_transform(range(1, 5), lambda j: CASE WHEN kind = 'reset' THEN NULL WHEN back THEN defs[j] WHEN kind = 'template' AND j = i THEN def WHEN kind = 'template' AND (j - 1) // 2 = source_id AND gones[j] <= export_s THEN NULL WHEN kind <> 'template' AND j = i AND (kind = 'withdraw' OR gones[j] <= export_s) THEN NULL ELSE defs[j] END) AS defs,
            list_transform(range(1, 5), lambda j: CASE WHEN kind = 'reset' THEN NULL WHEN back THEN gens[j] WHEN kind = 'template' AND j = i THEN new_gen WHEN kind = 'template' AND (j - 1) // 2 = source_id AND gones[j] <= export_s THEN NULL WHEN kind <> 'template' AND j = i AND (kind = 'withdraw' OR gones[j] <= export_s) THEN NULL ELSE gens[j] END) AS gens,
            list_transform(range(1, 5), lambda j: CASE WHEN kind = 'reset' THEN NULL WHEN back THEN gones[j] WHEN kind = 'template' AND j = i THEN export_s + {TTL_S} WHEN kind = 'template' AND (j - 1) // 2 = source_id AND gones[j] <= export_s THEN NULL WHEN kind <> 'template' AND j = i AND (kind = 'withdraw' OR gones[j] <= export_s) THEN NULL ELSE gones[j] END) AS gones
        FROM (SELECT *, CASE WHEN NOT alive THEN 1 WHEN held_def = def THEN held_gen ELSE held_gen + 1 END AS new_gen FROM (
            SELECT e.exporter, e.n, e.flow_id, e.kind, e.source_id, e.export_s, e.i, e.definition AS def, s.defs, s.gens, s.gones, s.clocks, s.defs[e.i] AS held_def, s.gens[e.i] AS held_gen,
                coalesce(s.gones[e.i] > e.export_s, false) AS alive, coalesce(e.export_s < s.clocks[e.source_id + 1], false) AND e.kind <> 'reset' AS back, len(list_filter(s.gens, lambda g: g IS NOT NULL)) AS held,
                len(list_filter(s.gones[e.source_id * 2 + 1 : e.source_id * 2 + 2], lambda g: g <= e.export_s)) AS old
            FROM st s JOIN ev e ON e.exporter = s.exporter AND e.n = s.n + 1))) x
)
SELECT flow_id, exporter, action, generation, pruned, definition FROM st WHERE n > 0"""


def _events(flows, spark):
    with shared.view(flows) as name:
        return spark.sql(_EVENTS.format(div="div", flows=name))


@query("template_transitions", TRANSITIONS_SQL)
def template_transitions(spark, sf_dir):
    """What every event did to its exporter's templates, and which template data are read by."""
    events = _events(views.flows(spark, sf_dir), spark)
    return templates.transitions(events, ["ts_us", "flow_id"], ttl_s=TTL_S).select("flow_id", "exporter", "action", "generation", F.col("pruned").cast("long").alias("pruned"), "definition")


@query("stream_templates", TRANSITIONS_SQL)
def stream_templates(spark, sf_dir):
    """The same from a stream, with the templates in keyed state."""
    events = _events(views.flows(spark, sf_dir, stream=True), spark).withColumn("ts", F.timestamp_micros("ts_us"))
    with live.rocks(spark):
        rows = live.drain(templates.live_transitions(events, ["ts_us", "flow_id"], "ts", ttl_s=TTL_S), shared.folder(spark, "stream"))
    return rows.select("flow_id", "exporter", "action", "generation", F.col("pruned").cast("long").alias("pruned"), "definition")
