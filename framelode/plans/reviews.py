"""Checks of reviewed tables (V2, V6, V7, V10, V13-V15, V17-V19, V21, V24, V26, V28) over tables made from records, scenes and samples.

The library's tables hold no reviews, so scenes stand for windows, groups' parts and clips, and
records for utterances; times, languages and settings are bent by fixed rules on text lengths and
counts, so that each rule meets rows that keep and rows that break it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import review as R
from ..functions import scalar as S
from ..functions.similarity import sequence_ratio
from ..session import cut_lineage
from .common import SCENES, SPEECH, VISION, rd, scenes, speech, vision
from .joins import _EV, ACTIVITY, _evidence, activity
from .registry import Registry

reg = Registry()


def _v(check: str, entity: str, message: str, asset: str = "asset_id") -> str:
    return f"""SELECT '{check}' AS "check", CAST({asset} AS VARCHAR) AS asset_id, CAST({entity} AS VARCHAR) AS entity_id, '{message.replace("'", "''")}' AS message"""


def _spans(t):
    return scenes(t).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))


_ITEM = "utterance_id || '#' || CAST(span_index AS VARCHAR)"


@reg.add(
    "v_packet",
    f"""WITH x AS MATERIALIZED (SELECT asset_id, {_ITEM} AS item, xs AS s, xe AS e, coalesce(span_text, '') AS text FROM {_EV}),
    f AS MATERIALIZED (SELECT x.asset_id, item, greatest(x.s, c.s) AS s, least(x.e, c.e) AS e, c.s <= (x.s + x.e) / 2 AND (x.s + x.e) / 2 < c.e AS owner FROM x JOIN {SCENES} c ON c.asset_id = x.asset_id AND x.s < c.e AND x.e > c.s),
    n AS (SELECT x.*, k, own FROM x LEFT JOIN (SELECT asset_id, item, count(*) AS k, count(*) FILTER (WHERE owner) AS own FROM f GROUP BY ALL) q USING (asset_id, item)),
    w AS (SELECT x.asset_id, x.item, x.s, x.e, f.e AS fe, f.s - coalesce(max(f.e) OVER (PARTITION BY x.asset_id, x.item ORDER BY f.s, f.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x.s) AS h FROM x JOIN f USING (asset_id, item) WHERE x.e > x.s AND f.e > f.s),
    h AS (SELECT asset_id, item FROM w GROUP BY asset_id, item, s, e HAVING greatest(max(h), e - max(fe)) > 0.002)
    {_v("packet", "item", "evidence in no window")} FROM n WHERE k IS NULL UNION ALL {_v("packet", "item", "text without exactly one owner")} FROM n WHERE trim(text) <> '' AND coalesce(own, 0) <> 1 UNION ALL {_v("packet", "item", "evidence isn't fully covered")} FROM h""",
)
def v_packet(t):
    """Scenes as windows of spans (V6)."""
    item = F.concat("utterance_id", F.lit("#"), F.col("span_index").cast("string"))
    x = cut_lineage(_evidence(t).select("asset_id", item.alias("item"), F.col("xs").alias("s"), F.col("xe").alias("e"), F.coalesce("span_text", F.lit("")).alias("text")))
    p = I.clipped(I.overlap_join(x.drop("text"), _spans(t), "asset_id", ("s", "e"), ("cs", "ce")), ("s", "e"), ("cs", "ce"), "fs", "fe")
    mid = (F.col("s") + F.col("e")) / 2
    f = cut_lineage(p.select("asset_id", "item", F.col("fs").alias("s"), F.col("fe").alias("e"), ((F.col("cs") <= mid) & (mid < F.col("ce"))).alias("owner")))
    return R.packet(x, f, "asset_id")


_NEXT = f"(SELECT asset_id, utterance_id, s, e, text, requested_locale, lead(utterance_id) OVER (PARTITION BY asset_id, requested_locale ORDER BY s, utterance_id) AS nxt FROM {SPEECH})"


def _with_next(t):
    """Records with the id of the next one of their asset and locale."""
    from ..operators.ordered import with_bucket
    from ..operators.sequence import with_next

    x = with_next(with_bucket(speech(t), "s"), ["asset_id", "requested_locale"], "_b", ["s", "utterance_id"], ["utterance_id"], "_n")
    return cut_lineage(x.select("asset_id", "utterance_id", "requested_locale", "s", "e", "text", "conf", F.col("_n.utterance_id").alias("nxt")))


@reg.add(
    "v_reconciled",
    f"""WITH w AS MATERIALIZED (SELECT asset_id, scene_id AS window_id, s AS ws, e AS we FROM {SCENES}),
    u AS MATERIALIZED (SELECT n.asset_id, w.window_id, n.utterance_id, n.s, n.e, CASE WHEN length(n.text) % 11 = 0 THEN 'uncertain' ELSE substr(requested_locale, 1, 2) END AS language, CASE WHEN length(n.text) % 13 = 0 THEN '' ELSE n.text END AS text, nxt FROM {_NEXT} n JOIN w ON w.asset_id = n.asset_id AND n.s >= w.ws AND n.s < w.we),
    c AS MATERIALIZED (SELECT DISTINCT u.asset_id, u.window_id, u.utterance_id, q.id AS source_id FROM u LEFT JOIN (SELECT DISTINCT utterance_id, unnest(CASE WHEN length(text) % 17 = 0 THEN [] ELSE [utterance_id, nxt] END) AS id FROM {_NEXT}) q ON q.utterance_id = u.utterance_id AND q.id IS NOT NULL),
    o AS MATERIALIZED (SELECT w.window_id, r.utterance_id AS source_id FROM w JOIN {SPEECH} r ON r.asset_id = w.asset_id AND r.s < w.we AND r.e > w.ws)
    {_v("reconciled", "window_id", "window without review")} FROM w WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.asset_id = w.asset_id AND u.window_id = w.window_id)
    UNION ALL {_v("reconciled", "utterance_id", "language isn't of the list")} FROM u WHERE language NOT IN ('ko', 'en', 'mixed', 'uncertain', 'non_speech') UNION ALL {_v("reconciled", "utterance_id", "outside its window", "u.asset_id")} FROM u JOIN w USING (window_id) WHERE s < ws - 0.001 OR e > we + 0.001 OR e <= s
    UNION ALL {_v("reconciled", "utterance_id", "no text")} FROM u WHERE language NOT IN ('uncertain', 'non_speech') AND trim(text) = '' UNION ALL {_v("reconciled", "utterance_id", "no source")} FROM c WHERE source_id IS NULL
    UNION ALL SELECT DISTINCT * FROM ({_v("reconciled", "utterance_id", "source wasn't offered")} FROM c WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.window_id = c.window_id AND o.source_id = c.source_id))""",
)
def v_reconciled(t):
    """Records as reviewed utterances of the scenes they start in; each cites itself and the next one (V7)."""
    w = _spans(t).select("asset_id", F.col("scene_id").alias("window_id"), F.col("cs").alias("ws"), F.col("ce").alias("we"))
    n = _with_next(t)
    size = F.length("text")
    starts = I.spread(w, "ws", "we", "_bk").join(n.withColumn("_bk", F.floor(F.col("s") / I.BUCKET_S).cast("long")), ["asset_id", "_bk"]).filter("s >= ws AND s < we")
    u = cut_lineage(starts.select("asset_id", "window_id", "utterance_id", "s", "e", F.when(size % 11 == 0, "uncertain").otherwise(F.substring("requested_locale", 1, 2)).alias("language"), F.when(size % 13 == 0, "").otherwise(F.col("text")).alias("text")))
    src = n.select("utterance_id", F.explode(F.when(size % 17 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("utterance_id", "nxt")))).alias("source_id")).distinct()
    o = I.overlap_join(speech(t).select("asset_id", F.col("utterance_id").alias("source_id"), "s", "e"), w, "asset_id", ("s", "e"), ("ws", "we")).select("window_id", "source_id")
    return R.reconciled(w, u, src, o, "asset_id")


@reg.add(
    "v_captions",
    f"""WITH x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id, requested_locale ORDER BY s, utterance_id) AS number FROM {_NEXT}),
    u AS MATERIALIZED (SELECT asset_id, utterance_id, s AS us, e AS ue, CASE WHEN length(text) % 9 = 0 THEN 'en' ELSE substr(requested_locale, 1, 2) END AS ul FROM x),
    r AS MATERIALIZED (SELECT asset_id, requested_locale, number, utterance_id || '-C' AS caption_id, s - (length(text) % 5) * 0.4 AS s, e + (length(text) % 4) * 0.6 AS e, substr(requested_locale, 1, 2) AS language, CASE WHEN length(text) % 19 = 0 THEN ' ' ELSE text END AS text, utterance_id, nxt FROM x WHERE length(text) % 23 <> 0),
    c AS MATERIALIZED (SELECT DISTINCT caption_id, unnest(CASE WHEN length(text) % 7 = 0 THEN [utterance_id, coalesce(nxt, 'none')] ELSE [utterance_id] END) AS utterance_id FROM r),
    d AS (SELECT DISTINCT asset_id, duration FROM assets),
    f AS (SELECT r.asset_id, r.caption_id, r.s, r.e, r.language, us, ue, ul FROM r JOIN c USING (caption_id) LEFT JOIN u ON u.asset_id = r.asset_id AND u.utterance_id = c.utterance_id),
    o AS MATERIALIZED (SELECT asset_id, caption_id, s, e, language, count(us) AS n, count(*) AS a, min(us) AS lo, max(ue) AS hi, count(DISTINCT ul) AS langs, min(ul) AS lang, bool_or(s >= ue OR e <= us) AS apart, any_value(duration) AS duration FROM f LEFT JOIN d USING (asset_id) GROUP BY asset_id, caption_id, s, e, language),
    p AS (SELECT *, lag(s) OVER (PARTITION BY asset_id, requested_locale ORDER BY number, caption_id) AS ps FROM r)
    {_v("captions", "caption_id", "id isn't unique")} FROM r GROUP BY asset_id, caption_id HAVING count(*) > 1 UNION ALL {_v("captions", "caption_id", "no text")} FROM r WHERE trim(text) = '' UNION ALL {_v("captions", "caption_id", "outside the media")} FROM o WHERE s < 0 OR e <= s OR e > duration + 0.001
    UNION ALL {_v("captions", "caption_id", "starts before the one before it")} FROM p WHERE s < ps UNION ALL {_v("captions", "caption_id", "cites an unknown utterance")} FROM o WHERE n < a
    UNION ALL {_v("captions", "caption_id", "too far from its utterances")} FROM o WHERE s < greatest(0.0, lo - 1.0) - 0.001 OR e > least(duration, hi + 1.5) + 0.001 UNION ALL {_v("captions", "caption_id", "doesn't overlap each utterance")} FROM o WHERE apart
    UNION ALL {_v("captions", "caption_id", "language differs from its utterances")} FROM o WHERE n > 0 AND language IS DISTINCT FROM CASE WHEN langs = 1 THEN lang ELSE 'mixed' END
    UNION ALL {_v("captions", "utterance_id", "utterance without caption")} FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.utterance_id = u.utterance_id)""",
)
def v_captions(t):
    """Captions a little beside their records."""
    from ..operators.ordered import with_bucket
    from ..operators.sequence import with_row_number

    x = with_row_number(with_bucket(_with_next(t), "s"), ["asset_id", "requested_locale"], "_b", ["s", "utterance_id"], "number")
    size, lang = F.length("text"), F.substring("requested_locale", 1, 2)
    x = cut_lineage(x)
    u = x.select("asset_id", "utterance_id", F.col("s").alias("us"), F.col("e").alias("ue"), F.when(size % 9 == 0, "en").otherwise(lang).alias("ul"))
    r = x.filter(size % 23 != 0).select("asset_id", "requested_locale", "number", F.concat("utterance_id", F.lit("-C")).alias("caption_id"), (F.col("s") - (size % 5) * 0.4).alias("s"), (F.col("e") + (size % 4) * 0.6).alias("e"), lang.alias("language"), F.when(size % 19 == 0, " ").otherwise(F.col("text")).alias("text"), "utterance_id", "nxt")
    two = F.length("text") % 7 == 0
    c = r.select("caption_id", F.explode(F.when(two, F.array("utterance_id", F.coalesce("nxt", F.lit("none")))).otherwise(F.array("utterance_id"))).alias("utterance_id")).distinct()
    return R.captions(r.drop("utterance_id", "nxt"), u, c, t.assets.select("asset_id", "duration").distinct(), "asset_id", "requested_locale")


@reg.add(
    "v_beats",
    f"""WITH r AS MATERIALIZED (SELECT asset_id, group_id, scene_id AS beat_id, s, e, CASE WHEN confidence < 0.5 THEN 'extend_after' ELSE 'none' END AS adjustment, CASE notable_count % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'not_applicable' END AS closure FROM {SCENES} WHERE group_id IS NOT NULL),
    g AS MATERIALIZED (SELECT asset_id, group_id, min(s) AS gs, round(max(e) - 0.5) AS ge FROM r GROUP BY ALL), a AS MATERIALIZED (SELECT asset_id, s AS anchor FROM {SPEECH} UNION SELECT asset_id, e FROM {SPEECH} UNION SELECT asset_id, ts FROM {VISION} UNION SELECT asset_id, gs FROM g),
    u AS MATERIALIZED (SELECT asset_id, utterance_id, s, e FROM {SPEECH}),
    c AS MATERIALIZED (SELECT r.asset_id, r.group_id, r.beat_id, r.s, r.e, u.utterance_id AS item, u.s AS xs, u.e AS xe FROM r JOIN u ON u.asset_id = r.asset_id AND u.s >= r.s AND u.s < r.e),
    i AS MATERIALIZED (SELECT g.asset_id, g.group_id, u.utterance_id AS item FROM g JOIN u ON u.asset_id = g.asset_id AND u.s >= g.gs AND u.s < g.ge),
    n AS (SELECT i.asset_id, i.item, k FROM i LEFT JOIN (SELECT asset_id, group_id, item, count(*) AS k FROM c GROUP BY ALL) q ON q.asset_id = i.asset_id AND q.group_id = i.group_id AND q.item = i.item),
    p AS (SELECT *, lag(e) OVER (PARTITION BY asset_id, group_id ORDER BY s, beat_id) AS pe FROM r)
    {_v("beats", "beat_id", "overlaps the beat before it")} FROM p WHERE s < pe - 0.001
    UNION ALL {_v("beats", "beat_id", "edge without anchor")} FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.asset_id = r.asset_id AND abs(a.anchor - r.s) <= 0.001) OR NOT EXISTS (SELECT 1 FROM a WHERE a.asset_id = r.asset_id AND abs(a.anchor - r.e) <= 0.001)
    UNION ALL {_v("beats", "beat_id", "crosses the end of its group", "r.asset_id")} FROM r JOIN g USING (asset_id, group_id) WHERE e > ge + 0.001 AND adjustment = 'none' UNION ALL {_v("beats", "beat_id", "open dialogue without adjustment")} FROM r WHERE closure = 'open' AND adjustment = 'none'
    UNION ALL SELECT DISTINCT * FROM ({_v("beats", "c.beat_id", "cuts a utterance", "c.asset_id")} FROM c JOIN i ON i.asset_id = c.asset_id AND i.group_id = c.group_id AND i.item = c.item WHERE c.xe > c.e + 0.001)
    UNION ALL {_v("beats", "item", "utterance in no beat")} FROM n WHERE k IS NULL UNION ALL {_v("beats", "item", "utterance in several beats")} FROM n WHERE k > 1""",
)
def v_beats(t):
    """Scenes as beats of their groups; groups end on whole seconds, so that some are crossed."""
    sc = scenes(t).filter("group_id IS NOT NULL")
    closure = F.when(F.col("notable_count") % 3 == 0, "open").when(F.col("notable_count") % 3 == 1, "closed").otherwise("not_applicable")
    r = cut_lineage(sc.select("asset_id", "group_id", F.col("scene_id").alias("beat_id"), "s", "e", F.when(F.col("confidence") < 0.5, "extend_after").otherwise("none").alias("adjustment"), closure.alias("closure")))
    g = cut_lineage(r.groupBy("asset_id", "group_id").agg(F.min("s").alias("gs"), F.round(F.max("e") - 0.5).alias("ge")))
    u = cut_lineage(speech(t).select("asset_id", F.col("utterance_id").alias("item"), F.col("s").alias("xs"), F.col("e").alias("xe")))
    anchors = u.select("asset_id", F.explode(F.array("xs", "xe")).alias("anchor")).unionByName(vision(t).select("asset_id", F.col("ts").alias("anchor"))).unionByName(g.select("asset_id", F.col("gs").alias("anchor")))
    at = u.withColumn("_bk", F.floor(F.col("xs") / I.BUCKET_S).cast("long"))
    inside = lambda spans, a, b: I.spread(spans, a, b, "_bk").join(at, ["asset_id", "_bk"]).filter((F.col("xs") >= F.col(a)) & (F.col("xs") < F.col(b))).withColumn("kind", F.lit("utterance"))
    cites = inside(r, "s", "e").select("beat_id", "kind", "item")
    items = inside(g, "gs", "ge").select("asset_id", "group_id", "kind", "item", "xs", "xe")
    return R.beats(r, g, anchors, cites, items, "asset_id")


@reg.add(
    "v_clip_evidence",
    f"""WITH b AS MATERIALIZED (SELECT asset_id, scene_id AS beat_id, s, e, tags, notable_count FROM {SCENES}),
    f AS MATERIALIZED (SELECT b.asset_id, beat_id, CAST(sample_id AS VARCHAR) AS sample_id, ts AS t FROM b JOIN {VISION} v ON v.asset_id = b.asset_id AND ts >= b.s AND ts < b.e),
    h AS MATERIALIZED (SELECT b.asset_id, beat_id, utterance_id, u.s AS us, u.e AS ue FROM b JOIN {SPEECH} u ON u.asset_id = b.asset_id AND u.s < b.e AND u.e > b.s),
    ff AS (SELECT asset_id, beat_id, min(t) AS a, max(t) AS z, arg_min(sample_id, (t, sample_id)) AS first FROM f GROUP BY ALL), hh AS (SELECT asset_id, beat_id, arg_min(utterance_id, (us, utterance_id)) AS said FROM h GROUP BY ALL),
    k AS MATERIALIZED (SELECT b.asset_id, b.beat_id, b.s, b.e, coalesce(a, b.s) + CASE WHEN notable_count % 2 = 1 THEN 0.01 ELSE 0.0 END AS a, coalesce(z, b.e) AS b FROM b LEFT JOIN ff USING (asset_id, beat_id)),
    n AS MATERIALIZED (SELECT asset_id, beat_id, t AS anchor FROM f UNION SELECT asset_id, beat_id, unnest([us, ue]) FROM h UNION SELECT asset_id, beat_id, unnest([s, e]) FROM b),
    q AS (SELECT asset_id, beat_id, s, e, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS i FROM b),
    c AS MATERIALIZED (SELECT q.asset_id, q.beat_id, q.beat_id || '/' || CAST(i AS VARCHAR) AS claim_id, CASE i WHEN 1 THEN 'audio' WHEN 2 THEN 'quality' ELSE 'subjects' END AS section, CASE WHEN length(tag) % 2 = 0 THEN 'speech' ELSE 'music' END AS kind, CASE length(tag) % 4 WHEN 0 THEN 'visual' WHEN 1 THEN 'speech' WHEN 2 THEN 'inferred' END AS basis, s AS x, s + 4.0 * (i + 1) AS y, CASE WHEN i % 2 = 0 AND first IS NOT NULL THEN [first] ELSE [] END AS samples, CASE WHEN i % 3 > 0 AND said IS NOT NULL THEN [said] ELSE [] END AS utterances FROM q LEFT JOIN ff USING (asset_id, beat_id) LEFT JOIN hh USING (asset_id, beat_id)),
    cf AS (SELECT c.*, t FROM (SELECT asset_id, beat_id, claim_id, x, y, unnest(samples) AS sample_id FROM c) c LEFT JOIN f USING (asset_id, beat_id, sample_id)), ch AS (SELECT c.*, us, ue FROM (SELECT asset_id, beat_id, claim_id, x, y, unnest(utterances) AS utterance_id FROM c) c LEFT JOIN h USING (asset_id, beat_id, utterance_id))
    {_v("clip_evidence", "beat_id", "core range outside its beat")} FROM k WHERE a < s - 0.001 OR b > e + 0.001 OR b <= a
    UNION ALL {_v("clip_evidence", "beat_id", "core range without anchor")} FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.asset_id = k.asset_id AND n.beat_id = k.beat_id AND abs(k.a - anchor) <= 0.001) OR NOT EXISTS (SELECT 1 FROM n WHERE n.asset_id = k.asset_id AND n.beat_id = k.beat_id AND abs(k.b - anchor) <= 0.001)
    UNION ALL {_v("clip_evidence", "beat_id", "core range cuts speech")} FROM k WHERE EXISTS (SELECT 1 FROM h WHERE h.asset_id = k.asset_id AND h.beat_id = k.beat_id AND greatest(a, us) < least(b, ue) AND (a > us + 0.001 OR b < ue - 0.001))
    UNION ALL {_v("clip_evidence", "claim_id", "claim outside its beat", "c.asset_id")} FROM c JOIN b USING (asset_id, beat_id) WHERE x < s - 0.001 OR y > e + 0.001 OR y <= x UNION ALL {_v("clip_evidence", "claim_id", "frame outside the claim")} FROM cf WHERE t < x - 0.001 OR t > y + 0.001
    UNION ALL {_v("clip_evidence", "claim_id", "speech outside the claim")} FROM ch WHERE greatest(x, us) >= least(y, ue) UNION ALL {_v("clip_evidence", "claim_id", "no basis or evidence")} FROM c WHERE basis IS NULL OR len(samples) + len(utterances) = 0
    UNION ALL {_v("clip_evidence", "claim_id", "evidence of another kind than the basis")} FROM c WHERE (basis = 'visual' AND len(samples) = 0) OR (basis = 'speech' AND len(utterances) = 0)
    UNION ALL {_v("clip_evidence", "claim_id", "audio that nobody heard")} FROM c WHERE section = 'audio' AND (coalesce(basis = 'visual', FALSE) OR (kind <> 'speech' AND coalesce(basis <> 'inferred', FALSE))) UNION ALL {_v("clip_evidence", "claim_id", "quality told from speech")} FROM c WHERE section = 'quality' AND basis = 'speech'""",
)
def v_clip_evidence(t):
    """Scenes as clips from their first to their last sample, their tags as claims."""
    b = cut_lineage(scenes(t).select("asset_id", F.col("scene_id").alias("beat_id"), "s", "e", "tags", "notable_count"))
    spans = b.select("asset_id", "beat_id", F.col("s").alias("cs"), F.col("e").alias("ce"))
    f = cut_lineage(I.points_in(vision(t), spans, "asset_id", "ts", ("cs", "ce")).filter("ts < ce").select("asset_id", "beat_id", F.col("sample_id").cast("string").alias("sample_id"), F.col("ts").alias("t")))
    h = cut_lineage(I.overlap_join(speech(t).select("asset_id", "utterance_id", F.col("s").alias("us"), F.col("e").alias("ue")), spans, "asset_id", ("us", "ue"), ("cs", "ce")).select("asset_id", "beat_id", "utterance_id", "us", "ue"))
    k = ["asset_id", "beat_id"]
    ff = f.groupBy(*k).agg(F.min("t").alias("_a"), F.max("t").alias("_z"), F.min_by("sample_id", F.struct("t", "sample_id")).alias("first"))
    hh = h.groupBy(*k).agg(F.min_by("utterance_id", F.struct("us", "utterance_id")).alias("said"))
    cores = b.join(ff, k, "left").select(*k, "s", "e", (F.coalesce("_a", "s") + F.when(F.col("notable_count") % 2 == 1, 0.01).otherwise(0.0)).alias("a"), F.coalesce("_z", "e").alias("b"))
    anchors = f.select(*k, F.col("t").alias("anchor")).unionByName(h.select(*k, F.explode(F.array("us", "ue")).alias("anchor"))).unionByName(b.select(*k, F.explode(F.array("s", "e")).alias("anchor")))
    q = b.select(*k, "s", F.posexplode("tags").alias("i", "tag")).join(ff, k, "left").join(hh, k, "left")
    size, none = F.length("tag"), F.array().cast("array<string>")
    claims = q.select(
        *k, F.concat_ws("/", "beat_id", F.col("i").cast("string")).alias("claim_id"), F.when(F.col("i") == 1, "audio").when(F.col("i") == 2, "quality").otherwise("subjects").alias("section"), F.when(size % 2 == 0, "speech").otherwise("music").alias("kind"),
        F.when(size % 4 == 0, "visual").when(size % 4 == 1, "speech").when(size % 4 == 2, "inferred").alias("basis"), F.col("s").alias("x"), (F.col("s") + 4.0 * (F.col("i") + 1)).alias("y"),
        F.when((F.col("i") % 2 == 0) & F.col("first").isNotNull(), F.array("first")).otherwise(none).alias("samples"), F.when((F.col("i") % 3 > 0) & F.col("said").isNotNull(), F.array("said")).otherwise(none).alias("utterances"),
    )
    return R.clip_evidence(cores, anchors, h, cut_lineage(claims), f, "asset_id")


@reg.add(
    "v_edit_plan",
    f"""WITH c AS MATERIALIZED (SELECT DISTINCT asset_id, scene_id, source_in, source_out, CASE WHEN notable_count % 5 = 4 THEN 0.2 WHEN highlighted THEN 0.5 ELSE 2.0 END AS speed, 24.0 - notable_count * 30.0 AS gain, CAST(floor(coalesce(confidence, 0.0) * 100) AS BIGINT) % 5 * 90 AS rotation, CASE WHEN notable_count > 1 THEN notable_count - 2.0 END AS tr FROM scenes),
    x AS (SELECT c.*, duration, (source_out - source_in) / speed AS len, lead((source_out - source_in) / speed) OVER w AS nlen, lead(scene_id) OVER w IS NULL AS final FROM c LEFT JOIN (SELECT DISTINCT asset_id, duration FROM assets) a USING (asset_id) WINDOW w AS (PARTITION BY asset_id ORDER BY scene_id))
    {_v("edit_plan", "scene_id", "unknown source")} FROM x WHERE duration IS NULL UNION ALL {_v("edit_plan", "scene_id", "no length")} FROM x WHERE source_out <= source_in OR source_in < 0 UNION ALL {_v("edit_plan", "scene_id", "ends after its source")} FROM x WHERE source_out > duration + 0.2
    UNION ALL {_v("edit_plan", "scene_id", "speed outside its limits")} FROM x WHERE speed NOT BETWEEN 0.25 AND 8 UNION ALL {_v("edit_plan", "scene_id", "gain outside its limits")} FROM x WHERE coalesce(gain NOT BETWEEN -60 AND 24, TRUE) UNION ALL {_v("edit_plan", "scene_id", "rotation isn't a right angle")} FROM x WHERE rotation NOT IN (0, 90, 180, 270)
    UNION ALL {_v("edit_plan", "scene_id", "transition after the last clip")} FROM x WHERE tr IS NOT NULL AND final UNION ALL {_v("edit_plan", "scene_id", "transition without length")} FROM x WHERE tr <= 0 UNION ALL {_v("edit_plan", "scene_id", "transition longer than a neighbour")} FROM x WHERE tr >= len OR tr >= nlen""",
)
def v_edit_plan(t):
    """Scenes as clips of one plan per asset, with settings of which some are out of bounds."""
    from ..operators.sequence import with_row_number

    n = F.col("notable_count")
    c = t.scenes.select("asset_id", "scene_id", "source_in", "source_out", "highlighted", "notable_count", "confidence").distinct().withColumn("_b", F.substring("scene_id", 1, 6))
    c = with_row_number(c, ["asset_id"], "_b", ["scene_id"], "number")
    rotation = F.floor(F.coalesce("confidence", F.lit(0.0)) * 100).cast("long") % 5 * 90
    c = c.select("asset_id", "number", F.col("scene_id").alias("clip_id"), F.col("asset_id").alias("source"), "source_in", "source_out", F.when(n % 5 == 4, 0.2).when(F.col("highlighted"), 0.5).otherwise(2.0).alias("speed"), (24.0 - n * 30.0).alias("volume_db"), rotation.alias("rotation"), F.when(n > 1, n - 2.0).alias("transition"))
    return R.edit_plan(cut_lineage(c), t.assets.select(F.col("asset_id").alias("source"), "duration").distinct(), "asset_id")


@reg.add(
    "v_moments",
    f"""WITH v AS (SELECT v.*, duration FROM {VISION} v JOIN (SELECT DISTINCT asset_id, duration FROM assets) a USING (asset_id) WHERE sample_id % 20 = 0 OR ae > 0.5),
    r AS MATERIALIZED (SELECT asset_id, CAST(sample_id AS VARCHAR) AS id, greatest(0.0, ts - 1.0) AS s, ts + 1.0 AS e, ts + CASE WHEN face_count > 2 THEN 2.0 ELSE 0.0 END AS at_, CASE WHEN person_count > 0 THEN ['visual', 'candid'] WHEN is_utility THEN ['utility'] ELSE ['visual'] END AS roles, CASE WHEN face_count > 0 THEN 'candid' ELSE 'visual' END AS prim, ae + 0.2 AS score, duration, sample_id FROM v),
    h AS MATERIALIZED (SELECT r.asset_id, id, r.s, r.e, least(r.e - r.s, coalesce(sum(CASE WHEN p.s IS NOT NULL THEN CAST(least(r.e, p.e) - greatest(r.s, p.s) AS DECIMAL(24,9)) END), 0)::DOUBLE) AS shared FROM r LEFT JOIN {ACTIVITY} p ON p.asset_id = r.asset_id AND r.s < p.e AND r.e > p.s GROUP BY r.asset_id, id, r.s, r.e),
    y AS (SELECT h.asset_id, id, shared, {rd("shared", 3)} + CASE WHEN sample_id % 7 = 0 THEN 0.5 ELSE 0.0 END AS secs, sample_id % 3 = 0 AS free FROM h JOIN r USING (asset_id, id))
    {_v("moments", "id", "outside the media")} FROM r WHERE s < 0 OR e <= s OR e > duration + 0.001 UNION ALL {_v("moments", "id", "representative outside it")} FROM r WHERE at_ < s - 0.001 OR at_ > e + 0.001 UNION ALL {_v("moments", "id", "role isn't of the list")} FROM r WHERE list_contains(roles, 'utility')
    UNION ALL {_v("moments", "id", "primary role isn't among its roles")} FROM r WHERE NOT list_contains(roles, prim) UNION ALL {_v("moments", "id", "score or confidence outside 0 to 1")} FROM r WHERE coalesce(score NOT BETWEEN 0 AND 1, TRUE)
    UNION ALL {_v("moments", "id", "seconds of speech differ")} FROM y WHERE abs(secs - shared) > 0.001 UNION ALL {_v("moments", "id", "freedom of speech differs")} FROM y WHERE free <> (shared <= 0.001)""",
)
def v_moments(t):
    """Moments of two seconds around some samples, with some wrong numbers."""
    a = cut_lineage(activity(t))
    v = vision(t).join(t.assets.select("asset_id", "duration").distinct(), "asset_id").filter("sample_id % 20 = 0 OR ae > 0.5")
    yes = lambda c: F.coalesce(c, F.lit(False))
    roles = F.when(yes(F.col("person_count") > 0), F.array(F.lit("visual"), F.lit("candid"))).when(yes(F.col("is_utility")), F.array(F.lit("utility"))).otherwise(F.array(F.lit("visual")))
    r = v.select("asset_id", F.col("sample_id").cast("string").alias("moment_id"), F.greatest(F.lit(0.0), F.col("ts") - 1.0).alias("s"), (F.col("ts") + 1.0).alias("e"), (F.col("ts") + F.when(yes(F.col("face_count") > 2), 2.0).otherwise(0.0)).alias("at"), roles.alias("roles"), F.when(yes(F.col("face_count") > 0), "candid").otherwise("visual").alias("primary_role"), (F.col("ae") + 0.2).alias("score"), F.lit(1.0).alias("confidence"), "sample_id")
    p = a.select("asset_id", F.col("s").alias("ps"), F.col("e").alias("pe"))
    said = I.shared_seconds(r, p, "asset_id", "moment_id", ("s", "e"), ("ps", "pe")).select("asset_id", "moment_id", "shared")
    wrong = F.when(F.col("sample_id") % 7 == 0, 0.5).otherwise(0.0)
    r = r.join(said, ["asset_id", "moment_id"]).withColumns({"speech_seconds": S.round_dec("shared", 3) + wrong, "speech_free": F.col("sample_id") % 3 == 0}).drop("shared", "sample_id")
    return R.moments(cut_lineage(r), a, t.assets.select("asset_id", "duration").distinct(), "asset_id")


_GROUPS = f"(SELECT asset_id, group_id, min(s) AS gs, max(e) AS ge, count(*) AS n, bool_or(highlighted) AS hi, max(label) AS label FROM {SCENES} WHERE group_id IS NOT NULL GROUP BY ALL)"


def _groups(t):
    return scenes(t).filter("group_id IS NOT NULL").groupBy("asset_id", "group_id").agg(F.min("s").alias("gs"), F.max("e").alias("ge"), F.count("*").alias("n"), F.bool_or("highlighted").alias("hi"), F.max("label").alias("label"))


@reg.add(
    "v_summary",
    f"""WITH g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY gs, group_id) AS place, row_number() OVER (PARTITION BY asset_id ORDER BY ge, group_id) AS told FROM {_GROUPS}),
    r AS (SELECT a.asset_id, title, tags, coalesce(h, []) AS h FROM (SELECT DISTINCT asset_id, title, tags FROM assets) a LEFT JOIN (SELECT asset_id, list(group_id) AS h FROM (SELECT asset_id, group_id FROM g WHERE hi UNION ALL SELECT asset_id, group_id || '?' FROM g WHERE n > 4) GROUP BY 1) x USING (asset_id)),
    p AS (SELECT coalesce(e.asset_id, g.asset_id) AS asset_id, e.group_id AS eg, g.group_id AS gg FROM g FULL JOIN (SELECT asset_id, told, group_id FROM g WHERE n < 6) e ON e.asset_id = g.asset_id AND e.told = g.place)
    {_v("summary", "asset_id", "no title")} FROM r WHERE trim(coalesce(title, '')) = '' UNION ALL {_v("summary", "asset_id", "more than three highlights or one named twice")} FROM r WHERE len(h) > 3 UNION ALL {_v("summary", "group_id || '?'", "unknown highlight")} FROM g WHERE n > 4
    UNION ALL {_v("summary", "asset_id", "tags are one to eight, none blank")} FROM r WHERE len(tags) NOT BETWEEN 1 AND 8 UNION ALL SELECT DISTINCT * FROM ({_v("summary", "asset_id", "events aren't the groups in order")} FROM p WHERE eg IS DISTINCT FROM gg)
    UNION ALL {_v("summary", "group_id", "event without headline")} FROM g WHERE n < 6 AND trim(coalesce(label, '')) = ''""",
)
def v_summary(t):
    """Assets as video summaries, their groups in the order of the ends as events."""
    from ..operators.ordered import with_bucket
    from ..operators.sequence import with_row_number

    g = with_row_number(with_bucket(_groups(t), "gs"), ["asset_id"], "_b", ["gs", "group_id"], "place").drop("_b")
    g = cut_lineage(with_row_number(with_bucket(g, "ge"), ["asset_id"], "_b", ["ge", "group_id"], "told"))
    h = g.filter("hi").select("asset_id", "group_id").unionByName(g.filter("n > 4").select("asset_id", F.concat("group_id", F.lit("?")).alias("group_id"))).groupBy("asset_id").agg(F.collect_list("group_id").alias("highlights"))
    r = t.assets.select("asset_id", "title", "tags").distinct().join(h, "asset_id", "left").withColumn("highlights", F.coalesce("highlights", F.array().cast("array<string>")))
    return R.summaries(r, g.filter("n < 6").select("asset_id", F.col("told").alias("place"), "group_id", F.col("label").alias("headline")), g.select("asset_id", "place", "group_id"), "asset_id")


@reg.add(
    "v_assignment",
    f"""WITH u AS (SELECT asset_id, utterance_id, s, e FROM {SPEECH}) {_v("assignment", "utterance_id", "overlaps no scene")} FROM u WHERE NOT EXISTS (SELECT 1 FROM {SCENES} c WHERE c.asset_id = u.asset_id AND u.s < c.e AND u.e > c.s)
    UNION ALL {_v("assignment", "utterance_id", "overlaps no group")} FROM u WHERE NOT EXISTS (SELECT 1 FROM {_GROUPS} g WHERE g.asset_id = u.asset_id AND u.s < g.ge AND u.e > g.gs)""",
)
def v_assignment(t):
    """Every record must meet a scene and a group."""
    from ..operators import constraints as C

    u = cut_lineage(speech(t).select("asset_id", "utterance_id", "s", "e"))
    out = []
    for spans, a, b, name in ((_spans(t), "cs", "ce", "scene"), (_groups(t).select("asset_id", "gs", "ge"), "gs", "ge", "group")):
        met = I.overlap_join(u, spans.select("asset_id", a, b), "asset_id", ("s", "e"), (a, b)).select("asset_id", "utterance_id").distinct()
        out.append(C.violations(u.join(met, ["asset_id", "utterance_id"], "left_anti"), "assignment", "asset_id", "utterance_id", F.lit(True), f"overlaps no {name}"))
    return C.all_of(*out)


@reg.add(
    "v_media_drift",
    """WITH a AS (SELECT DISTINCT asset_id, duration AS d, length(source_name) AS k, proxy_path FROM assets WHERE duration IS NOT NULL), x AS (SELECT asset_id, CASE WHEN k % 7 = 0 THEN 'hevc' ELSE 'h264' END AS codec, CASE WHEN k % 5 = 0 THEN 1920 ELSE 1280 END AS w, d + (k % 4) * 0.3 AS pd, d, 30000.0 / 1001 AS sf, CASE WHEN k % 6 = 0 THEN 30.0 ELSE 29.97 END AS pf, k % 9 = 0 AS mute FROM a WHERE proxy_path IS NOT NULL)
    SELECT asset_id, r AS reasons FROM (SELECT asset_id, list_filter([CASE WHEN codec <> 'h264' THEN 'codec' END, CASE WHEN w > 1280 THEN 'dimensions' END, CASE WHEN abs(pd - d) > greatest(0.5, d * 0.001) THEN 'duration' END, CASE WHEN abs(pf - sf) > 0.02 THEN 'frame_rate' END, CASE WHEN mute THEN 'audio' END], lambda v: v IS NOT NULL) AS r FROM x) WHERE len(r) > 0""",
)
def v_media_drift(t):
    """Proxies against their sources (V19); lengths of names stand for what a probe reads."""
    a = t.assets.filter("duration IS NOT NULL").select("asset_id", "duration", F.length("source_name").alias("k"), "proxy_path").distinct()
    src = a.select("asset_id", "duration", S.rational(F.lit("30000/1001")).alias("fps"), F.lit("aac").alias("audio"))
    k = F.col("k")
    cp = a.filter("proxy_path IS NOT NULL").select("asset_id", F.when(k % 7 == 0, "hevc").otherwise("h264").alias("codec"), F.when(k % 5 == 0, 1920).otherwise(1280).alias("width"), F.lit(720).alias("height"), (F.col("duration") + (k % 4) * 0.3).alias("duration"), F.when(k % 6 == 0, 30.0).otherwise(29.97).alias("fps"), F.when(k % 9 != 0, "aac").alias("audio"))
    return R.proxies(src, cp, "asset_id")


@reg.add("v_coarseness")
def v_coarseness(t):
    """Groups that are coarse or repeat themselves."""
    sc = scenes(t).filter("group_id IS NOT NULL")
    g = sc.groupBy("asset_id", "group_id").agg((F.max("e") - F.min("s")).alias("seconds"), F.min_by("summary", F.struct("s", "scene_id")).alias("description"))
    return R.coarseness(g, sc.select("asset_id", "group_id", F.col("scene_id").alias("beat_id"), "s", "summary"), sequence_ratio, "asset_id").filter(F.size("flags") > 0)


@reg.add(
    "v_review_reasons",
    f"""WITH c AS (SELECT asset_id, scene_id, s AS a, e AS b, len(tags) > 0 AS ev, notable_count % 3 AS k, confidence FROM {SCENES}), o AS (SELECT c.asset_id, scene_id, bool_or(contains(text, '…') OR contains(text, '...')) AS unsure, bool_or(u.s < a - 0.001 OR u.e > b + 0.001) AS cut FROM c JOIN {SPEECH} u ON u.asset_id = c.asset_id AND u.s < b AND u.e > a GROUP BY ALL)
    SELECT asset_id, scene_id, list_filter([CASE WHEN NOT ev THEN 'editorial_evidence_missing' WHEN coalesce(k <> 1, TRUE) THEN 'event_closure_unconfirmed' END, CASE WHEN coalesce(confidence < 0.5, FALSE) THEN 'neighbor_boundary_review' END, CASE WHEN k = 0 THEN 'dialogue_open' END, CASE WHEN unsure THEN 'caption_uncertainty' END, CASE WHEN cut THEN 'speech_boundary_cut' END], lambda v: v IS NOT NULL) AS reasons FROM c LEFT JOIN o USING (asset_id, scene_id)""",
)
def v_review_reasons(t):
    """All reasons to look at a scene again."""
    key = ["asset_id", "scene_id"]
    n = F.col("notable_count") % 3
    closed = F.when(n == 1, "closed").otherwise("open")
    c = scenes(t).select(*key, F.col("s").alias("a"), F.col("e").alias("b"), (F.size("tags") > 0).alias("evidence"), closed.alias("closure"), F.when(F.col("confidence") < 0.5, "extend_after").otherwise("none").alias("adjustment"), F.when(n == 0, "open").otherwise("closed").alias("dialogue"))
    said = I.overlap_join(speech(t).select("asset_id", "s", "e", "text"), c.select(*key, "a", "b"), "asset_id", ("s", "e"), ("a", "b")).select(*key, "s", "e", "text")
    return R.review_reasons(c, said, key)


@reg.add(
    "v_hand_over",
    """WITH a AS (SELECT DISTINCT asset_id, length(source_name) AS k, scene_count FROM assets), f AS (SELECT DISTINCT asset_id, scene_id AS path, CASE WHEN notable_count = 2 THEN 'old' ELSE md5(coalesce(title, '')) END AS digest, md5(coalesce(title, '')) AS now, coalesce(confidence, 1.0) > 0.35 AS there FROM scenes)
    SELECT 'hand_over' AS "check", asset_id, asset_id AS entity_id, 'schema differs' AS message FROM a WHERE k % 8 = 0 UNION ALL SELECT 'hand_over', asset_id, asset_id, 'state of another asset' FROM a WHERE k % 11 = 0 UNION ALL SELECT 'hand_over', asset_id, asset_id, 'policy differs' FROM a WHERE k % 5 = 0 OR k % 3 = 0
    UNION ALL SELECT 'hand_over', asset_id, path, 'file is gone' FROM f WHERE NOT there UNION ALL SELECT 'hand_over', asset_id, path, 'file has changed' FROM f WHERE there AND digest <> now UNION ALL SELECT 'hand_over', asset_id, asset_id, 'no file recorded' FROM a WHERE asset_id NOT IN (SELECT asset_id FROM f)""",
)
def v_hand_over(t):
    """Assets as prepared states with their scenes as files."""
    a = t.assets.select("asset_id", F.length("source_name").alias("k")).distinct()
    k = F.col("k")
    policy = F.create_map(F.lit("beats"), F.when(k % 5 == 0, "optional").otherwise("required"), F.lit("cover"), F.when(k % 3 != 0, "all"))
    st = a.select("asset_id", F.when(k % 8 == 0, "state/v0").otherwise("state/v1").alias("schema_version"), F.when(k % 11 == 0, "other").otherwise(F.col("asset_id")).alias("stated_id"), policy.alias("policy"))
    sc = t.scenes.select("asset_id", F.col("scene_id").alias("path"), F.md5(F.coalesce("title", F.lit(""))).alias("now"), "notable_count", "confidence").distinct()
    f = sc.select("asset_id", "path", F.when(F.col("notable_count") == 2, "old").otherwise(F.col("now")).alias("digest"))
    now = sc.filter(F.coalesce("confidence", F.lit(1.0)) > 0.35).select("path", F.col("now").alias("digest"))
    return R.hand_over(st, f, now, "asset_id", schema="state/v1", policy={"beats": "required", "cover": "all"})


@reg.add(
    "v_review_order",
    f"""WITH m AS (SELECT asset_id, scene_id, group_id, row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS place, row_number() OVER (PARTITION BY asset_id ORDER BY e, scene_id) AS told, notable_count FROM {SCENES}),
    r AS (SELECT asset_id, told, scene_id, group_id FROM m WHERE notable_count < 5 OR notable_count IS NULL UNION ALL SELECT asset_id, told, scene_id, 'again' FROM m WHERE notable_count = 2), q AS (SELECT asset_id, scene_id, min(told) AS at_, count(group_id) AS n FROM r GROUP BY ALL),
    x AS (SELECT m.asset_id, m.scene_id, place, at_, n FROM m LEFT JOIN q USING (asset_id, scene_id)), g AS (SELECT r.asset_id, r.group_id, max(place) - min(place) + 1 AS wide, count(DISTINCT scene_id) AS n FROM r JOIN m USING (asset_id, scene_id) WHERE r.group_id IS NOT NULL GROUP BY ALL)
    {_v("review_order", "scene_id", "not reviewed")} FROM x WHERE at_ IS NULL UNION ALL {_v("review_order", "scene_id", "in another place")} FROM x WHERE at_ <> place UNION ALL {_v("review_order", "scene_id", "in no group")} FROM x WHERE n = 0 UNION ALL {_v("review_order", "scene_id", "in several groups")} FROM x WHERE n > 1
    UNION ALL {_v("review_order", "group_id", "group with a gap")} FROM g WHERE wide > n""",
)
def v_review_order(t):
    """Scenes in the order of their starts as the machine's, in that of their ends as the reviewed segments (V2)."""
    from ..operators.ordered import with_bucket
    from ..operators.sequence import with_row_number

    m = with_row_number(with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "scene_id"], "place").drop("_b")
    m = cut_lineage(with_row_number(with_bucket(m, "e"), ["asset_id"], "_b", ["e", "scene_id"], "told").select("asset_id", F.col("scene_id").alias("segment_id"), "group_id", "place", "told", "notable_count"))
    r = m.filter("notable_count < 5 OR notable_count IS NULL").select("asset_id", F.col("told").alias("place"), "segment_id", "group_id").unionByName(m.filter("notable_count = 2").select("asset_id", F.col("told").alias("place"), "segment_id", F.lit("again").alias("group_id")))
    return R.in_order(m.select("asset_id", "place", "segment_id"), r, "asset_id")
