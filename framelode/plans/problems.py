"""Queries of the general problems: covered time (6) and capture instants (7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.coverage import covered_periods, to_ms
from ..operators.instants import asset_instants
from .registry import Registry

reg = Registry()


@reg.add(
    "p6_found",
    """
    WITH r AS (
      SELECT 'scenes' AS source_table, asset_id, CAST(round(source_in * 1000) AS BIGINT) AS s, CAST(round(source_out * 1000) AS BIGINT) AS e FROM scenes
      UNION ALL
      SELECT 'stt_candidates', asset_id, CAST(round("start" * 1000) AS BIGINT), CAST(round("end" * 1000) AS BIGINT) FROM stt_candidates),
    f AS (SELECT *, max(e) OVER (PARTITION BY source_table, asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r WHERE e > s AND asset_id IS NOT NULL),
    i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY source_table, asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM f),
    p AS (SELECT source_table, asset_id, n, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
    g AS (SELECT source_table, asset_id, e AS s, lead(s) OVER (PARTITION BY source_table, asset_id ORDER BY n) AS e FROM p)
    SELECT source_table, asset_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
    UNION ALL SELECT source_table, asset_id, 'gap', s, e FROM g WHERE e IS NOT NULL""",
)
def p6_found(t):
    rows = t.scenes.select(F.lit("scenes").alias("source_table"), "asset_id", to_ms("source_in").alias("start_ms"), to_ms("source_out").alias("end_ms")).unionByName(
        t.stt_candidates.select(F.lit("stt_candidates").alias("source_table"), "asset_id", to_ms("start").alias("start_ms"), to_ms("end").alias("end_ms"))
    )
    return covered_periods(rows, ["source_table", "asset_id"], "start_ms", "end_ms").select("source_table", "asset_id", "kind", "start_ms", "end_ms")


@reg.add("p7_found")
def p7_found(t):
    return asset_instants(t.assets, t.trip_config).filter("utc_ms IS NOT NULL")
