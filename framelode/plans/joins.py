"""Joins (J) and interval algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import intervals as I
from .common import OCR, PEOPLE, SCENES, SPANS, SPEECH, VISION, ocr, people, rd, scenes, spans, speech, vision
from .registry import Registry

reg = Registry()


def _scene_spans(t):
    return scenes(t).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))


_SC = f"(SELECT asset_id, scene_id, s AS cs, e AS ce FROM {SCENES})"


@reg.add("j_overlap", f"""SELECT utterance_id, scene_id, {rd("greatest(s, cs)", 6)} AS shared_start, {rd("least(e, ce)", 6)} AS shared_end FROM {SPEECH} JOIN {_SC} USING (asset_id) WHERE s < ce AND e > cs""")
def j_overlap(t):
    """Speech and scenes that share time, with what they share."""
    pairs = I.clipped(I.overlap_join(speech(t), _scene_spans(t), "asset_id", ("s", "e"), ("cs", "ce")), ("s", "e"), ("cs", "ce"), "x", "y")
    return pairs.select("utterance_id", "scene_id", S.round_dec("x", 6).alias("shared_start"), S.round_dec("y", 6).alias("shared_end"))


_SCORE = "CAST(least(1.0, conf) - 1 - greatest(0.0, 1 - conf - 0.4) - greatest(0.0, length(text) / 20.0 - 2.0) * 0.15 AS DECIMAL(24,12))"


@reg.add(
    "j_candidate_preference",
    f"""WITH p AS (SELECT scene_id, requested_locale, CAST(greatest(0.25, e - s) AS DECIMAL(24,12)) AS d, {_SCORE} AS score FROM {SPEECH} JOIN {_SC} USING (asset_id) WHERE s < ce AND e > cs AND conf IS NOT NULL),
    g AS (SELECT scene_id, requested_locale, {rd("sum(CAST(score AS DOUBLE) * CAST(d AS DOUBLE)) / sum(d)", 4)} AS score FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, requested_locale DESC) AS k, lead(score) OVER (PARTITION BY scene_id ORDER BY score DESC, requested_locale DESC) AS second FROM g)
    SELECT scene_id, score AS best_score, CASE WHEN second IS NULL OR CAST(score AS DECIMAL(12,4)) - CAST(second AS DECIMAL(12,4)) >= 0.15 THEN requested_locale ELSE 'mixed_or_uncertain' END AS preference FROM r WHERE k = 1""",
)
def j_candidate_preference(t):
    """Which locale's candidates fit a scene better, by duration-weighted score with penalties."""
    p = I.overlap_join(speech(t).filter("conf IS NOT NULL"), _scene_spans(t), "asset_id", ("s", "e"), ("cs", "ce"))
    score = F.least(F.lit(1.0), F.col("conf")) - 1 - F.greatest(F.lit(0.0), 1 - F.col("conf") - 0.4) - F.greatest(F.lit(0.0), F.length("text") / 20.0 - 2.0) * 0.15
    d = F.greatest(F.lit(0.25), F.col("e") - F.col("s"))
    g = p.groupBy("scene_id", "requested_locale").agg(S.round_dec(F.sum(score * d) / F.sum(d), 4).alias("score"))
    w = Window.partitionBy("scene_id").orderBy(F.desc("score"), F.desc("requested_locale"))
    r = g.withColumns({"k": F.row_number().over(w), "second": F.lead("score").over(w)}).filter("k = 1")
    clear = F.col("second").isNull() | (F.col("score").cast("decimal(12,4)") - F.col("second").cast("decimal(12,4)") >= F.lit("0.15").cast("decimal(3,2)"))
    return r.select("scene_id", F.col("score").alias("best_score"), F.when(clear, F.col("requested_locale")).otherwise("mixed_or_uncertain").alias("preference"))


@reg.add(
    "j_best_overlap",
    f"""WITH p AS (SELECT utterance_id, scene_id, row_number() OVER (PARTITION BY utterance_id ORDER BY round(CAST(least(e, ce) - greatest(s, cs) AS DECIMAL(24,12)), 6) DESC, cs, ce, scene_id) AS k FROM {SPEECH} JOIN {_SC} USING (asset_id) WHERE s < ce AND e > cs)
    SELECT utterance_id, scene_id FROM {SPEECH} LEFT JOIN (SELECT * FROM p WHERE k = 1) USING (utterance_id)""",
)
def j_best_overlap(t):
    """Each transcript record with the one scene it shares most time with."""
    # One scene per place, so that ties end at the first scene id.
    one = scenes(t).groupBy("asset_id", "s", "e").agg(F.min("scene_id").alias("scene_id")).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))
    return I.best_overlap(speech(t), one, "asset_id", "utterance_id", ("s", "e"), "scene_id", ("cs", "ce")).select("utterance_id", "scene_id")


@reg.add(
    "j_nearest_sample",
    f"""WITH v AS (SELECT asset_id, ts AS vt, min(sample_id) AS sample_id FROM {VISION} GROUP BY ALL), o AS (SELECT asset_id, line_id, ts FROM {OCR}),
    b AS (SELECT o.*, v.vt AS bt, v.sample_id AS bid FROM o ASOF LEFT JOIN v ON o.asset_id = v.asset_id AND o.ts >= v.vt), a AS (SELECT b.*, v.vt AS at2, v.sample_id AS aid FROM b ASOF LEFT JOIN v ON b.asset_id = v.asset_id AND b.ts <= v.vt)
    SELECT line_id, CASE WHEN bt IS NULL THEN aid WHEN at2 IS NULL OR ts - bt <= at2 - ts THEN bid ELSE aid END AS sample_id FROM a""",
)
def j_nearest_sample(t):
    """Each sign line with the vision sample nearest in time, the earlier on ties."""
    v = vision(t).select("asset_id", F.col("ts").alias("vt"), "sample_id")
    return I.nearest(ocr(t).select("asset_id", "line_id", "ts"), v, "asset_id", "ts", "vt", ["sample_id"]).select("line_id", "sample_id")


@reg.add(
    "j_nearest_of_several",
    f"""WITH s AS (SELECT asset_id, scene_id, s AS ts FROM {SCENES}),
    v AS (SELECT asset_id, ts AS vt, min(sample_id) AS sample_id FROM {VISION} GROUP BY ALL), p AS (SELECT asset_id, ts AS pt, min(detection_id) AS detection_id FROM {PEOPLE} GROUP BY ALL),
    b AS (SELECT s.*, v.vt AS bt, v.sample_id AS bid FROM s ASOF LEFT JOIN v ON s.asset_id = v.asset_id AND s.ts >= v.vt), a AS (SELECT b.*, v.vt AS at2, v.sample_id AS aid FROM b ASOF LEFT JOIN v ON b.asset_id = v.asset_id AND b.ts <= v.vt),
    one AS (SELECT asset_id, scene_id, ts, CASE WHEN bt IS NULL THEN aid WHEN at2 IS NULL OR ts - bt <= at2 - ts THEN bid ELSE aid END AS sample_id FROM a),
    c AS (SELECT one.*, p.pt AS bt, p.detection_id AS bid FROM one ASOF LEFT JOIN p ON one.asset_id = p.asset_id AND one.ts >= p.pt), d AS (SELECT c.*, p.pt AS at2, p.detection_id AS aid FROM c ASOF LEFT JOIN p ON c.asset_id = p.asset_id AND c.ts <= p.pt)
    SELECT scene_id, sample_id, CASE WHEN bt IS NULL THEN aid WHEN at2 IS NULL OR ts - bt <= at2 - ts THEN bid ELSE aid END AS detection_id FROM d""",
)
def j_nearest_of_several(t):
    """Scene starts with the nearest vision sample and the nearest person detection."""
    s = scenes(t).select("asset_id", "scene_id", F.col("s").alias("ts"))
    one = I.nearest(s, vision(t).select("asset_id", F.col("ts").alias("vt"), "sample_id"), "asset_id", "ts", "vt", ["sample_id"]).drop("vt")
    both = I.nearest(one, people(t).select("asset_id", F.col("ts").alias("pt"), "detection_id"), "asset_id", "ts", "pt", ["detection_id"])
    return both.select("scene_id", "sample_id", "detection_id")


@reg.add("j_points_in_scenes", f"""WITH m AS (SELECT asset_id, max(ce) AS last FROM {_SC} GROUP BY ALL) SELECT sample_id, scene_id FROM {VISION} JOIN {_SC} USING (asset_id) JOIN m USING (asset_id) WHERE ts >= cs AND (ts < ce OR (ce = last AND ts = ce))""")
def j_points_in_scenes(t):
    """Vision samples with the scenes that hold them."""
    return I.points_in(vision(t), _scene_spans(t), "asset_id", "ts", ("cs", "ce")).select("sample_id", "scene_id")


@reg.add(
    "j_points_with_context",
    f"""WITH s AS (SELECT scene_id, asset_id, s AS cs, e AS ce FROM {SCENES}), p AS (SELECT asset_id, detection_id, ts FROM {PEOPLE})
    SELECT scene_id, CAST(count(*) FILTER (WHERE ts >= cs AND ts < ce) AS BIGINT) AS inside, max(CASE WHEN ts < cs THEN ts END) AS before_ts, min(CASE WHEN ts >= ce THEN ts END) AS after_ts
    FROM s JOIN p USING (asset_id) WHERE ts >= cs - 15 AND ts <= ce + 15 GROUP BY scene_id""",
)
def j_points_with_context(t):
    """Detections inside a scene and the nearest ones before and after it within a radius."""
    s = _scene_spans(t).withColumns({"ws": F.col("cs") - 15.0, "we": F.col("ce") + 15.0})
    p = people(t).select("asset_id", "detection_id", "ts").withColumns({"ps": F.col("ts"), "pe": F.col("ts")})
    x, y = I.spread(p, "ps", "pe", "_bk"), I.spread(s, "ws", "we", "_bk")
    hit = x.join(y, ["asset_id", "_bk"]).filter("ts >= ws AND ts <= we")
    return hit.groupBy("scene_id").agg(F.count_if((F.col("ts") >= F.col("cs")) & (F.col("ts") < F.col("ce"))).alias("inside"), F.max(F.when(F.col("ts") < F.col("cs"), F.col("ts"))).alias("before_ts"), F.min(F.when(F.col("ts") >= F.col("ce"), F.col("ts"))).alias("after_ts"))


@reg.add(
    "j_neighbour_windows",
    f"""WITH s AS (SELECT scene_id, asset_id, s AS cs, e AS ce FROM {SCENES}), u AS (SELECT * FROM {SPEECH}),
    b AS (SELECT scene_id, arg_min(utterance_id, (-e, utterance_id)) AS previous_id FROM s JOIN u USING (asset_id) WHERE e <= cs + 0.001 GROUP BY 1),
    a AS (SELECT scene_id, arg_min(utterance_id, (s.cs * 0 + u.s, utterance_id)) AS next_id FROM s JOIN u USING (asset_id) WHERE u.s >= ce - 0.001 GROUP BY 1)
    SELECT scene_id, previous_id, next_id FROM s LEFT JOIN b USING (scene_id) LEFT JOIN a USING (scene_id)""",
)
def j_neighbour_windows(t):
    """The transcript record that ends last before a scene and the one that starts first after it."""
    u = speech(t).select("asset_id", "utterance_id", F.col("s").alias("us"), F.col("e").alias("ue"))
    return I.neighbours(_scene_spans(t), u, "asset_id", "scene_id", ("cs", "ce"), "utterance_id", ("us", "ue")).select("scene_id", "previous_id", "next_id")


@reg.add("j_boundary_crossing", f"""SELECT utterance_id, scene_id, 'start' AS edge FROM {SPEECH} JOIN {_SC} USING (asset_id) WHERE s < cs AND e > cs UNION ALL SELECT utterance_id, scene_id, 'end' FROM {SPEECH} JOIN {_SC} USING (asset_id) WHERE s < ce AND e > ce""")
def j_boundary_crossing(t):
    """Transcript records that hold an edge of a scene strictly inside."""
    edges = _scene_spans(t).select("asset_id", "scene_id", F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("cs").alias("at")), F.struct(F.lit("end").alias("edge"), F.col("ce").alias("at")))).alias("x")).select("asset_id", "scene_id", "x.edge", F.col("x.at").alias("at"))
    u = I.spread(speech(t), "s", "e", "_bk")
    pts = edges.withColumn("_bk", F.floor(F.col("at") / I.BUCKET_S).cast("long"))
    return u.join(pts, ["asset_id", "_bk"]).filter("s < at AND e > at").select("utterance_id", "scene_id", "edge")


@reg.add(
    "j_context_of_scenes",
    f"""WITH s AS (SELECT scene_id, asset_id, s AS cs, e AS ce FROM {SCENES}), u AS (SELECT asset_id, utterance_id, s AS us, e AS ue FROM {SPEECH}),
    b AS (SELECT scene_id, utterance_id, ue, row_number() OVER (PARTITION BY scene_id ORDER BY ue DESC, utterance_id DESC) AS k FROM s JOIN u USING (asset_id) WHERE ue <= cs),
    a AS (SELECT scene_id, utterance_id, us, row_number() OVER (PARTITION BY scene_id ORDER BY us, utterance_id DESC) AS k FROM s JOIN u USING (asset_id) WHERE us >= ce),
    o AS (SELECT scene_id, list(utterance_id ORDER BY us, utterance_id) AS ids FROM s JOIN u USING (asset_id) WHERE us < ce AND ue > cs GROUP BY 1)
    SELECT scene_id, coalesce((SELECT list(utterance_id ORDER BY ue, utterance_id) FROM b WHERE b.scene_id = s.scene_id AND k <= 2), []) AS previous_ids, coalesce(o.ids, []) AS overlapping_ids,
    coalesce((SELECT list(utterance_id ORDER BY us, utterance_id DESC) FROM a WHERE a.scene_id = s.scene_id AND k <= 2), []) AS next_ids FROM s LEFT JOIN o USING (scene_id)""",
)
def j_context_of_scenes(t):
    """Records that overlap a scene and two before and after it."""
    u = speech(t).select("asset_id", "utterance_id", F.col("s").alias("us"), F.col("e").alias("ue"))
    return I.context_ids(_scene_spans(t), u, "asset_id", "scene_id", ("cs", "ce"), "utterance_id", ("us", "ue")).select("scene_id", "previous_ids", "overlapping_ids", "next_ids")


@reg.add("j_proximity", f"""SELECT detection_id FROM {PEOPLE} p WHERE EXISTS (SELECT 1 FROM {OCR} o WHERE o.asset_id = p.asset_id AND abs(o.ts - p.ts) <= 0.5)""")
def j_proximity(t):
    """Person detections within half a second of a sign line."""
    o = ocr(t).select("asset_id", F.col("ts").alias("ot"))
    return I.near_semi(people(t), o, "asset_id", "ts", "ot", 0.5).select("detection_id")


@reg.add("j_consensus", f"""SELECT utterance_id FROM {SPEECH} a WHERE EXISTS (SELECT 1 FROM {SPEECH} b WHERE b.asset_id = a.asset_id AND b.requested_locale <> a.requested_locale AND abs(b.e - a.e) <= 0.35)""")
def j_consensus(t):
    """Segment ends that another locale places at nearly the same time."""
    a = t.once("speech", speech)
    b = a.select("asset_id", F.col("requested_locale").alias("other_locale"), F.col("e").alias("other_end"))
    return I.near_semi(a, b, "asset_id", "e", "other_end", 0.35, other=F.col("requested_locale") != F.col("other_locale")).select("utterance_id")


_EV = f"""(SELECT p.asset_id, p.utterance_id, p.span_index, p.span_text, CASE WHEN p.ss IS NOT NULL AND p.se > p.ss THEN p.ss ELSE u.s END AS xs, CASE WHEN p.ss IS NOT NULL AND p.se > p.ss THEN p.se ELSE u.e END AS xe,
 CASE WHEN p.ss IS NOT NULL AND p.se > p.ss THEN 'span' ELSE 'candidate_interval_fallback' END AS timing FROM {SPANS} p JOIN {SPEECH} u USING (asset_id, utterance_id))"""


def _evidence(t):
    """Spans with their own time, or that of their record where they have none."""
    j = spans(t).join(speech(t).select("asset_id", "utterance_id", "s", "e"), ["asset_id", "utterance_id"])
    own = F.col("ss").isNotNull() & (F.col("se") > F.col("ss"))
    return j.select("asset_id", "utterance_id", "span_index", "span_text", F.when(own, F.col("ss")).otherwise(F.col("s")).alias("xs"), F.when(own, F.col("se")).otherwise(F.col("e")).alias("xe"), F.when(F.coalesce(own, F.lit(False)), "span").otherwise("candidate_interval_fallback").alias("timing"))


@reg.add("j_text_owner", f"""SELECT utterance_id, CAST(span_index AS BIGINT) AS span_index, scene_id, (cs <= (xs + xe) / 2 AND (xs + xe) / 2 < ce) AS owner, timing FROM {_EV} JOIN {_SC} USING (asset_id) WHERE xs < ce AND xe > cs""")
def j_text_owner(t):
    """Spans and the scenes they touch; a span's text belongs to those that hold its middle."""
    pairs = I.overlap_join(_evidence(t), _scene_spans(t), "asset_id", ("xs", "xe"), ("cs", "ce"))
    mid = (F.col("xs") + F.col("xe")) / 2
    return pairs.select("utterance_id", F.col("span_index").cast("long").alias("span_index"), "scene_id", ((F.col("cs") <= mid) & (mid < F.col("ce"))).alias("owner"), "timing")


def _activity_sql(gap: str = "0.35") -> str:
    return f"""(WITH r AS (SELECT asset_id, s, e, max(e) OVER (PARTITION BY asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {SPEECH}),
 i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM r) SELECT asset_id, min(s) AS s, max(e) AS e FROM i GROUP BY asset_id, n)"""


def activity(t, gap: float = 0.35):
    """Times in which somebody speaks: unions of transcript records."""
    return I.merged(speech(t), ["asset_id"], "s", "e", gap=gap)


ACTIVITY = _activity_sql()


@reg.add("w_merge_intervals", f"SELECT asset_id, s, e FROM {ACTIVITY}")
def w_merge_intervals(t):
    return activity(t)


@reg.add(
    "w_complement",
    f"""WITH a AS (SELECT DISTINCT asset_id, duration AS d FROM assets WHERE duration > 0), c AS (SELECT asset_id, greatest(0.0, least(s, d)) AS s, greatest(0.0, least(e, d)) AS e, d FROM {_activity_sql("0.0")} JOIN a USING (asset_id)),
    v AS (SELECT * FROM c WHERE e > s), h AS (SELECT asset_id, coalesce(lag(e) OVER (PARTITION BY asset_id ORDER BY s), 0.0) AS s, s AS e FROM v),
    l AS (SELECT a.asset_id, coalesce(max(v.e), 0.0) AS s, a.d AS e FROM a LEFT JOIN v ON a.asset_id = v.asset_id GROUP BY a.asset_id, a.d)
    SELECT asset_id, s, e FROM h WHERE e > s UNION ALL SELECT asset_id, s, e FROM l WHERE e > s""",
)
def w_complement(t):
    """Time of an asset in which nobody speaks, head and tail included."""
    return I.complement(activity(t, 0.0), t.assets.select("asset_id", "duration").distinct(), "asset_id", "s", "e", "duration")


@reg.add(
    "w_split_bounded",
    f"""WITH n AS (SELECT scene_id, s, e, CAST(greatest(1, ceil((e - s) / 5.0)) AS BIGINT) AS n FROM {SCENES}), x AS (SELECT *, unnest(range(0, n)) AS i FROM n)
    SELECT scene_id, i AS piece, {rd("s + i * ((e - s) / n)", 3)} AS piece_start, {rd("CASE WHEN i = n - 1 THEN e ELSE s + (i + 1) * ((e - s) / n) END", 3)} AS piece_end FROM x""",
)
def w_split_bounded(t):
    """Scenes in equal pieces of at most five seconds."""
    x = I.split_evenly(scenes(t).select("scene_id", "s", "e"), "s", "e", 5.0)
    return x.select("scene_id", F.col("piece").cast("long").alias("piece"), S.round_dec("s", 3).alias("piece_start"), S.round_dec("e", 3).alias("piece_end"))


@reg.add(
    "a_overlap_seconds",
    f"""WITH p AS (SELECT scene_id, sum(CAST(least(ce, e) - greatest(cs, s) AS DECIMAL(24,9))) AS x FROM {_SC} JOIN {ACTIVITY} USING (asset_id) WHERE cs < e AND ce > s GROUP BY 1)
    SELECT scene_id, {rd("least(ce - cs, coalesce(CAST(x AS DOUBLE), 0.0))", 6)} AS shared, {rd("least(ce - cs, coalesce(CAST(x AS DOUBLE), 0.0)) / (ce - cs)", 4)} AS share FROM {_SC} LEFT JOIN p USING (scene_id)""",
)
def a_overlap_seconds(t):
    """Seconds of a scene in which somebody speaks."""
    x = I.shared_seconds(_scene_spans(t), activity(t), "asset_id", "scene_id", ("cs", "ce"), ("s", "e"))
    return x.select("scene_id", S.round_dec("shared", 6).alias("shared"), S.round_dec("share", 4).alias("share"))


@reg.add(
    "m_coverage_holes",
    f"""WITH u AS (SELECT asset_id, utterance_id, s, e FROM {SPEECH}), f AS (SELECT u.utterance_id, u.s AS s0, u.e AS e0, greatest(p.ss, u.s) AS fs, least(p.se, u.e) AS fe FROM u JOIN {SPANS} p ON u.asset_id = p.asset_id AND u.utterance_id = p.utterance_id AND p.se > p.ss),
    w AS (SELECT *, fs - coalesce(max(fe) OVER (PARTITION BY utterance_id ORDER BY fs, fe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s0) AS h FROM f WHERE fe > fs), g AS (SELECT utterance_id, max(h) AS h, max(fe) AS m FROM w GROUP BY 1),
    x AS (SELECT u.utterance_id, greatest(coalesce(h, u.e - u.s), u.e - coalesce(m, u.s)) AS hole FROM u LEFT JOIN g USING (utterance_id)) SELECT utterance_id, {rd("hole", 6)} AS hole FROM x WHERE hole > 0.002""",
)
def m_coverage_holes(t):
    """Records whose spans leave more than two milliseconds of them uncovered (M3)."""
    s = speech(t).select("asset_id", "utterance_id", F.col("s").alias("from"), F.col("e").alias("to"))
    f = spans(t).filter("se > ss").select("asset_id", "utterance_id", F.col("ss").alias("from"), F.col("se").alias("to"))
    return I.uncovered(s, f, ["asset_id", "utterance_id"], "from", "to").select("utterance_id", S.round_dec("hole", 6).alias("hole"))
