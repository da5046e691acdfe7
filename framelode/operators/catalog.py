"""What a user asks of the library: lists, ranked search, evidence of a scene, scenes around a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .intervals import overlap_join, points_in


def list_assets(assets: DataFrame, capture_date: str | None = None, limit: int = 100) -> DataFrame:
    """Assets in capture order, those without a time last; ``capture_date`` is the start of a day."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is from 1 to 100")
    rows = assets.select("asset_id", "source_name", "creation_time", S.round_dec("duration", 3).alias("duration"), "title", S.shortened("summary", 180).alias("summary"), "tags", "scene_count", F.col("proxy_path").isNotNull().alias("proxy_ready")).distinct()
    if capture_date:
        rows = rows.filter(S.capture_day("creation_time").startswith(capture_date))
    return rows.orderBy(F.coalesce("creation_time", F.lit("9999")), "source_name", "asset_id").limit(limit)


def search_scenes(scenes: DataFrame, query: str = "", asset_ids: list[str] | None = None, highlight_only: bool = False, limit: int = 12) -> DataFrame:
    """Scenes by how well they fit (M9, T2): twice the shared words, 2.5 for the whole query, 0.8 for a highlight, up to 1
    for notable moments, a quarter of the confidence. With a query, scenes that share nothing with it are left out.
    """
    if not 1 <= limit <= 30:
        raise ValueError("limit is from 1 to 30")
    rows = scenes.filter(F.col("asset_id").isin(asset_ids)) if asset_ids else scenes
    if highlight_only:
        rows = rows.filter("highlighted")
    asked = S.tokens(F.lit(query))
    shared = F.size(F.array_intersect(S.tokens("search_text"), asked))
    folded = query.lower().strip()
    whole = F.coalesce(F.lower("search_text").contains(folded), F.lit(False)) if folded else F.lit(False)
    if folded:
        rows = rows.filter((shared > 0) | whole | (F.size(asked) == 0))
    score = shared * 2.0 + F.when(whole, 2.5).otherwise(0.0) + F.when(F.col("highlighted"), 0.8).otherwise(0.0) + F.least(F.lit(1.0), F.coalesce("notable_count", F.lit(0)) * 0.4) + F.coalesce("confidence", F.lit(0.0)) * 0.25
    return rows.select("scene_id", "asset_id", "title", S.round_dec(score, 6).alias("score")).distinct().orderBy(F.desc("score"), "scene_id").limit(limit)


#: Items of a scene's evidence: captions, candidates of one locale, frames.
EVIDENCE_LIMITS = {"captions": 30, "candidates": 8, "frames": 8}


def scene_evidence(scenes: DataFrame, speech: DataFrame, samples: DataFrame, scene_id: str | None = None) -> DataFrame:
    """What scenes rest on (get_scene_evidence): scene_id, title, records, captions, candidates, frames.

    ``scenes``: asset_id, scene_id, title, cs, ce. ``speech``: asset_id, utterance_id, requested_locale, s, e, text, conf. ``samples``: asset_id,
    sample_id, ts, ae. Captions are the records that overlap the scene and have text, in order of time; candidates the
    same by locale, in a map; frames the best samples inside, in order of time, of which the best is the representative.
    All lists are limited; ``records`` counts the overlapping records.
    """
    lim = EVIDENCE_LIMITS
    c = scenes if scene_id is None else scenes.filter(F.col("scene_id") == scene_id)
    said = overlap_join(speech, c.select("asset_id", "scene_id", "cs", "ce"), "asset_id", ("s", "e"), ("cs", "ce"))
    n = said.groupBy("scene_id").agg(F.count("*").alias("records"))
    order = ["s", "utterance_id"]
    listed = lambda x: F.transform(F.sort_array(F.collect_list(F.struct("_k", x.alias("x")))), lambda y: y["x"])
    texts = said.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    cap = texts.withColumn("_k", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order))).filter(F.col("_k") <= lim["captions"])
    cap = cap.groupBy("scene_id").agg(listed(F.struct(F.col("utterance_id").alias("id"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("requested_locale").alias("language"), "text", F.col("conf").alias("confidence"))).alias("captions"))
    cand = texts.filter("requested_locale IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("scene_id", "requested_locale").orderBy(*order))).filter(F.col("_k") <= lim["candidates"])
    cand = cand.groupBy("scene_id", "requested_locale").agg(listed(F.struct("text", F.col("s").alias("start"), F.col("e").alias("end"), F.col("conf").alias("confidence"))).alias("_v"))
    cand = cand.groupBy("scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("requested_locale", "_v")))).alias("candidates"))
    seen = points_in(samples, c.select("asset_id", "scene_id", "cs", "ce"), "asset_id", "ts", ("cs", "ce")).filter(F.col("ts") < F.col("ce"))
    best = Window.partitionBy("scene_id").orderBy(F.desc_nulls_last("ae"), "ts", "sample_id")
    frames = seen.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= lim["frames"])
    frame = F.struct("sample_id", F.col("ts").alias("time"), S.timecode("ts").alias("timecode"), F.when(F.col("_r") == 1, "representative").otherwise("key_moment").alias("role"))
    frames = frames.groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "sample_id", frame.alias("x")))), lambda y: y["x"]).alias("frames"))
    out = c.select("scene_id", "title").join(n, "scene_id", "left").join(cap, "scene_id", "left").join(cand, "scene_id", "left").join(frames, "scene_id", "left")
    return out.withColumn("records", F.coalesce("records", F.lit(0)))


# Limits of what a user interface may send and is shown.
UI_LIMITS = {"selected_scene_count": 12, "visible_asset_id_count": 60, "project_day_rollup_count": 31, "project_asset_index_count": 100, "nearby_asset_count": 8}
UI_SCHEMA = "editor-ui-state/v1"


def resolve_ui_context(assets: DataFrame, scenes: DataFrame, state: dict, limits: dict | None = None) -> dict:
    """What a user sees, made authoritative (resolve_ui_context, V27).

    ``state`` may have schema_version, current_asset_id, focused_scene_id, selected_scene_ids, visible_asset_ids and selected_range.
    Too many or unknown ids, a focused scene of another asset and a range outside it are errors; a range that
    isn't one is ignored. Result: current_asset_id, focused_scene_id, selected_range, and tables: selected (scenes in
    order of capture), nearby (assets around the current one), days (counts per day), assets (index), and the flags
    days_truncated and assets_truncated. Only rows named by ids, at most as many as the limits, come to the driver.
    """
    lim = UI_LIMITS | (limits or {})
    if state.get("schema_version") not in (None, UI_SCHEMA):
        raise ValueError(f"no state of version {state.get('schema_version')}")
    chosen, visible = (list(dict.fromkeys(map(str, state.get(k) or []))) for k in ("selected_scene_ids", "visible_asset_ids"))
    for ids, k in ((state.get("selected_scene_ids") or [], "selected_scene_count"), (state.get("visible_asset_ids") or [], "visible_asset_id_count")):
        if len(ids) > lim[k]:
            raise ValueError(f"at most {lim[k]} ids")
    focused = str(state.get("focused_scene_id") or "").strip() or None
    current = str(state.get("current_asset_id") or "").strip() or None
    wanted = {*chosen, *([focused] if focused else [])}
    found = {r["scene_id"]: r for r in scenes.filter(F.col("scene_id").isin([*wanted])).select("scene_id", "asset_id", "source_in", "source_out").distinct().collect()} if wanted else {}
    if gone := wanted - found.keys():
        raise KeyError(f"no scene {sorted(gone)[0]}")
    current = current or (found[focused]["asset_id"] if focused else None)
    named = {*visible, *([current] if current else [])}
    if named and (lost := named - {r[0] for r in assets.filter(F.col("asset_id").isin([*named])).select("asset_id").distinct().collect()}):
        raise KeyError(f"no asset {sorted(lost)[0]}")
    if focused and found[focused]["asset_id"] != current:
        raise ValueError("the focused scene isn't of the current asset")
    span = state.get("selected_range")
    try:
        a, b = round(float(span["source_in"]), 3), round(float(span["source_out"]), 3)
        span = {"source_in": a, "source_out": b} if 0 <= a <= b else None
    except (KeyError, TypeError, ValueError):
        span = None
    if span and focused and (span["source_in"] < found[focused]["source_in"] or span["source_out"] > found[focused]["source_out"]):
        raise ValueError("the range isn't in the focused scene")
    a = assets.select("asset_id", "source_name", "creation_time", "duration", "title", "scene_count").distinct().withColumns({"_c": F.coalesce("creation_time", F.lit("9999")), "capture_date": S.capture_day("creation_time")})
    s = scenes.filter(F.col("scene_id").isin(chosen)).select("scene_id", "asset_id", S.round_dec("source_in", 3).alias("source_in"), S.round_dec("source_out", 3).alias("source_out"), "title", S.shortened("summary", 160).alias("summary"), S.shortened("dialogue_excerpt", 100).alias("dialogue_excerpt"), "highlighted").distinct()
    s = s.join(a.select("asset_id", "_c", "source_name"), "asset_id").orderBy("_c", "source_name", "asset_id", "source_in", "scene_id").drop("_c", "source_name")
    days = a.groupBy("capture_date").agg(F.count("*").alias("asset_count"), F.sum("scene_count").cast("long").alias("scene_count"), S.round_dec(F.coalesce(F.sum(F.col("duration").cast("decimal(24,6)")).cast("double"), F.lit(0.0)), 3).alias("duration"))
    n_days, n_assets = lim["project_day_rollup_count"], lim["project_asset_index_count"]
    order = ["_c", "source_name", "asset_id"]
    index = a.orderBy(*order).limit(n_assets).select("asset_id", "capture_date", "title")
    return {
        "current_asset_id": current, "focused_scene_id": focused, "selected_range": span, "selected": s,
        "nearby": nearby(a, order, "asset_id", current, lim["nearby_asset_count"]), "days": days.orderBy("capture_date").limit(n_days), "assets": index,
        "days_truncated": len(days.select("capture_date").limit(n_days + 1).collect()) > n_days, "assets_truncated": len(a.select("asset_id").limit(n_assets + 1).collect()) > n_assets,
    }


def nearby(rows: DataFrame, order: list[str], id_col: str, mine: str | None, size: int) -> DataFrame:
    """id, place (from 0): ``size`` rows around one in the order, clamped at the ends (W29); none without it.

    Only counts and at most ``size`` neighbours on each side are ordered, never the whole table in one task.
    """
    key = F.struct(*order)
    keyed = rows.select(F.col(id_col), key.alias("_key"))
    me = keyed.filter(F.col(id_col) == mine).first() if mine is not None else None
    if me is None:
        return keyed.limit(0).select(id_col, F.lit(0).cast("long").alias("place"))
    at = F.struct(*(F.lit(me["_key"][c]).alias(c) for c in order))
    before = keyed.filter(F.col("_key") < at)
    i, n = before.count(), keyed.count()
    end = min(n, max(0, i - size // 2) + size)
    start = max(0, end - size)
    b = before.orderBy(F.desc("_key")).limit(size).withColumn("place", F.lit(i) - F.row_number().over(Window.orderBy(F.desc("_key"))))
    f = keyed.filter(F.col("_key") >= at).orderBy("_key").limit(size).withColumn("place", F.lit(i) + F.row_number().over(Window.orderBy("_key")) - 1)
    return b.unionByName(f).filter((F.col("place") >= start) & (F.col("place") < end)).select(id_col, F.col("place").cast("long").alias("place"))
