"""Constraints (V) and greedy choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import constraints as C
from ..operators import selection as L
from .common import OCR, PEOPLE, SCENES, SPANS, SPEECH, VISION, ocr, people, rd, scenes, spans, speech, vision
from ..session import cut_lineage
from .joins import _EV, ACTIVITY, _evidence, activity
from .registry import Registry
from .windows import ADAPTIVE, _nms_sql, w_adaptive_segments

reg = Registry()

_V = "SELECT '{c}' AS \"check\", CAST({a} AS VARCHAR) AS asset_id, CAST({e} AS VARCHAR) AS entity_id, '{m}' AS message"


def _v(c: str, e: str, m: str, a: str = "asset_id") -> str:
    return _V.format(c=c, a=a, e=e, m=m.replace("'", "''"))


_TILES = f"(SELECT asset_id, scene_id, {rd('s', 3)} AS s, {rd('e', 3)} AS e FROM {SCENES})"


@reg.add(
    "v_partition_cover",
    f"""WITH x AS (SELECT *, lag(e) OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS p FROM {_TILES}), m AS (SELECT asset_id, max(e) AS m FROM x GROUP BY 1), a AS (SELECT DISTINCT asset_id, duration FROM assets)
    {_v("partition_cover", "scene_id", "doesn't start at zero")} FROM x WHERE p IS NULL AND abs(s) > 0.002 UNION ALL {_v("partition_cover", "scene_id", "gap or overlap before it")} FROM x WHERE abs(s - p) > 0.002
    UNION ALL {_v("partition_cover", "scene_id", "no length")} FROM x WHERE e <= s UNION ALL {_v("partition_cover", "'end'", "doesn't reach the end", "m.asset_id")} FROM m JOIN a ON a.asset_id = m.asset_id WHERE abs(m - duration) > 0.002""",
)
def v_partition_cover(t):
    """Scenes should tile their asset (V1)."""
    x = scenes(t).select("asset_id", "scene_id", S.round_dec("s", 3).alias("s"), S.round_dec("e", 3).alias("e"))
    return C.tiling(x, t.assets.select("asset_id", "duration").distinct(), "asset_id", "scene_id", "s", "e", "duration", "partition_cover")


@reg.add("v_storyboard", f"""{_v("storyboard", "scene_id", "more than three notable moments")} FROM {SCENES} WHERE notable_count > 3 UNION ALL {_v("storyboard", "scene_id", "no tag")} FROM {SCENES} WHERE len(tags) = 0""")
def v_storyboard(t):
    """At most three notable moments and at least one tag (parts of V3, V17)."""
    x = scenes(t)
    return C.all_of(C.violations(x, "storyboard", "asset_id", "scene_id", F.col("notable_count") > 3, "more than three notable moments"), C.violations(x, "storyboard", "asset_id", "scene_id", F.size("tags") == 0, "no tag"))


@reg.add("v_source_identity", f"""{_v("source_identity", "proxy_path", "one proxy of several fingerprints", "proxy_path")} FROM (SELECT proxy_path FROM assets WHERE proxy_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT quick_fingerprint) > 1)""")
def v_source_identity(t):
    """A path must stand for one content (V4)."""
    n = t.assets.filter("proxy_path IS NOT NULL").select("proxy_path", "quick_fingerprint").distinct().groupBy("proxy_path").agg(F.count("quick_fingerprint").alias("n"))
    return C.violations(n, "source_identity", "proxy_path", "proxy_path", F.col("n") > 1, "one proxy of several fingerprints")


@reg.add("v_orphans", f"""{_v("orphans", "utterance_id", "span of an unknown record")} FROM {SPANS} p WHERE NOT EXISTS (SELECT 1 FROM {SPEECH} u WHERE u.utterance_id = p.utterance_id)""")
def v_orphans(t):
    """Spans must refer to a known record."""
    return C.missing(spans(t), speech(t), "utterance_id", "orphans", "asset_id", "span of an unknown record")


@reg.add(
    "v_proposals",
    """SELECT 'proposals' AS "check", CAST(user_id AS VARCHAR) AS asset_id, CAST(event_id AS VARCHAR) AS entity_id, 'time doesn''t increase' AS message FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE epoch_us(ts) <= p""",
)
def v_proposals(t):
    """Times of events must increase with their number (the order rule of V9, on a table that breaks it)."""
    from ..operators.sequence import with_previous

    x = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("_b", F.floor(F.col("event_id") / 1000).cast("long"))
    x = with_previous(x, ["user_id"], "_b", ["event_id"], ["us"], "_p")
    return C.violations(x, "proposals", "user_id", "event_id", F.col("us") <= F.col("_p.us"), "time doesn't increase")


@reg.add("v_fused_proposals")
def v_fused_proposals(t):
    """Fused boundary proposals against the events they are made of (V9)."""
    from ..operators import ordered as O
    from ..session import cut_lineage
    from .windows import weighted_events

    e = cut_lineage(weighted_events(t))
    p = cut_lineage(O.fused_proposals(e, ["asset_id"], 2.0, keep_cluster=True)).withColumn("number", F.substring("proposal_id", 3, 18).cast("long"))
    made_of = O.anchored_clusters(e, ["asset_id"], "timestamp", "source_id", 2.0, kind="kind")
    return C.proposals(p, made_of, t.assets, "asset_id", "proposal_id", "number", "cluster", "duration", "fused_proposals", tolerance=2.0)


@reg.add("v_unchanged", """SELECT 'unchanged' AS "check", asset_id, scene_id AS entity_id, 'time of capture differs from its asset' AS message FROM (SELECT DISTINCT s.asset_id, s.scene_id FROM scenes s JOIN assets a USING (asset_id) WHERE s.creation_time IS DISTINCT FROM a.creation_time)""")
def v_unchanged(t):
    """Copied fields must equal their source."""
    a = t.assets.select("asset_id", F.col("creation_time").alias("c")).distinct()
    x = t.scenes.select("asset_id", "scene_id", "creation_time").distinct().join(a, "asset_id")
    return C.violations(x, "unchanged", "asset_id", "scene_id", ~F.col("creation_time").eqNullSafe(F.col("c")), "time of capture differs from its asset").distinct()


@reg.add("v_caption_timing", f"""WITH c AS (SELECT scene_id, asset_id, s, e FROM {SCENES}) {_v("caption_timing", "utterance_id", "in no scene")} FROM {SPEECH} u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.asset_id = u.asset_id AND c.s - 0.001 <= u.s AND u.e <= c.e + 0.001)""")
def v_caption_timing(t):
    """Records that no scene contains wholly."""
    from ..operators.intervals import spread

    u = spread(speech(t).withColumns({"us": F.col("s"), "ue": F.col("s")}), "us", "ue", "_bk")
    c = spread(scenes(t).select("asset_id", (F.col("s") - 0.001).alias("cs"), (F.col("e") + 0.001).alias("ce")), "cs", "ce", "_bk")
    inside = (u["asset_id"] == c["asset_id"]) & (u["_bk"] == c["_bk"]) & (c["cs"] <= u["s"]) & (u["e"] <= c["ce"])
    return C.violations(u.join(c, inside, "left_anti"), "caption_timing", "asset_id", "utterance_id", F.lit(True), "in no scene")


@reg.add("v_anchored_edges", f"""{_v("anchored_edges", "scene_id", "starts far from any sample")} FROM {SCENES} c WHERE NOT EXISTS (SELECT 1 FROM {VISION} v WHERE v.asset_id = c.asset_id AND abs(v.ts - c.s) <= 0.5)""")
def v_anchored_edges(t):
    """Edges must lie near evidence."""
    from ..operators.intervals import near_semi

    c = scenes(t).select("asset_id", "scene_id", "s")
    near = near_semi(c, vision(t).select("asset_id", F.col("ts").alias("vt")), "asset_id", "s", "vt", 0.5)
    return C.violations(c.join(near.select("scene_id"), "scene_id", "left_anti"), "anchored_edges", "asset_id", "scene_id", F.lit(True), "starts far from any sample")


@reg.add("v_person_boxes", f"""{_v("person_boxes", "detection_id", "box leaves the unit square")} FROM {PEOPLE} WHERE bounding_box[1] < 0 OR bounding_box[2] < 0 OR bounding_box[1] + bounding_box[3] > 1.000001 OR bounding_box[2] + bounding_box[4] > 1.000001""")
def v_person_boxes(t):
    """Boxes must lie in the unit square."""
    b = lambda i: F.get("bounding_box", F.lit(i))
    return C.violations(people(t), "person_boxes", "asset_id", "detection_id", (b(0) < 0) | (b(1) < 0) | (b(0) + b(2) > 1.000001) | (b(1) + b(3) > 1.000001), "box leaves the unit square")


@reg.add("v_config_ranges", """SELECT 'config_ranges' AS "check", trip_id AS asset_id, trip_id AS entity_id, 'threshold outside 0 to 1' AS message FROM trip_config WHERE min_language_probability NOT BETWEEN 0 AND 1 OR min_language_margin NOT BETWEEN 0 AND 1 UNION ALL SELECT 'config_ranges', trip_id, trip_id, 'few expected languages' FROM trip_config WHERE len(expected_languages) < 3""")
def v_config_ranges(t):
    """Settings within their ranges."""
    c = t.trip_config
    return C.all_of(C.violations(c, "config_ranges", "trip_id", "trip_id", ~F.col("min_language_probability").between(0, 1) | ~F.col("min_language_margin").between(0, 1), "threshold outside 0 to 1"), C.violations(c, "config_ranges", "trip_id", "trip_id", F.size("expected_languages") < 3, "few expected languages"))


@reg.add(
    "w_language_route",
    f"""WITH d AS (SELECT asset_id, lang, count(*) AS n FROM documents WHERE lang IN ('en', 'ko', 'ja', 'de', 'fr', 'es', 'pt') AND asset_id IS NOT NULL GROUP BY ALL), p AS (SELECT asset_id, lang, n / sum(n) OVER (PARTITION BY asset_id) AS p FROM d),
    r AS (SELECT *, row_number() OVER w AS k, lead(p) OVER w AS second FROM p WINDOW w AS (PARTITION BY asset_id ORDER BY p DESC, lang)), x AS (SELECT r.*, {rd("p - coalesce(second, 0)", 6)} AS margin, c.expected_languages AS ex, c.min_language_probability AS mp, c.min_language_margin AS mm FROM r JOIN (SELECT DISTINCT asset_id, trip_id FROM assets) a USING (asset_id) JOIN trip_config c USING (trip_id) WHERE k = 1),
    y AS (SELECT *, list_filter([CASE WHEN p < mp THEN 'low_language_probability' END, CASE WHEN margin < mm THEN 'low_language_margin' END, CASE WHEN NOT list_contains(ex, lang) THEN 'outside_expected_languages' END], lambda q: q IS NOT NULL) AS reasons FROM x)
    SELECT asset_id, lang AS selected_language, {rd("p", 6)} AS top_probability, margin, len(reasons) > 0 AS uncertain, array_to_string(reasons, ',') AS reasons, array_to_string(CASE WHEN len(reasons) > 0 THEN list_concat([lang], list_filter(ex, lambda q: q <> lang)) ELSE [lang] END, ',') AS candidates FROM y""",
)
def w_language_route(t):
    """The language an asset's documents suggest, what makes it doubtful, and which others to try."""
    d = t.documents.filter(F.col("lang").isin("en", "ko", "ja", "de", "fr", "es", "pt") & F.col("asset_id").isNotNull()).groupBy("asset_id", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("asset_id")
    p = d.withColumn("p", F.col("n") / F.sum("n").over(w))
    o = w.orderBy(F.desc("p"), "lang")
    r = p.withColumns({"k": F.row_number().over(o), "second": F.lead("p").over(o)}).filter("k = 1")
    x = r.join(t.assets.select("asset_id", "trip_id").distinct(), "asset_id").join(t.trip_config.drop("title", "time_zone"), "trip_id").withColumn("margin", S.round_dec(F.col("p") - F.coalesce("second", F.lit(0.0)), 6))
    why = F.array_compact(F.array(F.when(F.col("p") < F.col("min_language_probability"), "low_language_probability"), F.when(F.col("margin") < F.col("min_language_margin"), "low_language_margin"), F.when(~F.array_contains("expected_languages", F.col("lang")), "outside_expected_languages")))
    x = x.withColumn("why", why)
    tries = F.when(F.size("why") > 0, F.array_distinct(F.concat(F.array("lang"), "expected_languages"))).otherwise(F.array("lang"))
    return x.select("asset_id", F.col("lang").alias("selected_language"), S.round_dec("p", 6).alias("top_probability"), "margin", (F.size("why") > 0).alias("uncertain"), F.array_join("why", ",").alias("reasons"), F.array_join(tries, ",").alias("candidates"))


_BITS = "(bit_count(xor(CAST('0x' || substr({a}, 1, 8) AS BIGINT), CAST('0x' || substr({b}, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr({a}, 9, 8) AS BIGINT), CAST('0x' || substr({b}, 9, 8) AS BIGINT)))) / 64.0"


@reg.add(
    "w_hash_groups",
    f"""WITH RECURSIVE g AS (SELECT asset_id, segment_id, "start" AS s, "end" AS e, boundary_reason AS why FROM {ADAPTIVE}),
    h AS (SELECT asset_id, segment_id, substr(md5(CAST(CAST(floor(arg_min(ts, (-{rd("coalesce(ae, 0.0) - 0.12 * abs(ts - (s + e) / 2) / greatest(1.0, e - s)", 9)}, ts, sample_id)) / 60) AS BIGINT) AS VARCHAR)), 1, 16) AS h FROM g JOIN {VISION} USING (asset_id) WHERE ts >= s AND ts < e GROUP BY ALL),
    n AS (SELECT g.*, h, row_number() OVER w AS rn, lag(h) OVER w AS ph FROM g LEFT JOIN h USING (asset_id, segment_id) WINDOW w AS (PARTITION BY asset_id ORDER BY s, segment_id)),
    x AS MATERIALIZED (SELECT *, coalesce(why = 'visual_change' AND {_BITS.format(a="h", b="ph")} > 0.24, FALSE) AS hard FROM n),
    r AS (SELECT asset_id, rn, segment_id, segment_id AS grp, s AS first FROM x WHERE rn = 1 UNION ALL SELECT x.asset_id, x.rn, x.segment_id, CASE WHEN x.hard OR x.e - r.first > 90 THEN x.segment_id ELSE r.grp END, CASE WHEN x.hard OR x.e - r.first > 90 THEN x.s ELSE r.first END FROM r JOIN x ON x.asset_id = r.asset_id AND x.rn = r.rn + 1)
    SELECT asset_id, segment_id, grp AS "group" FROM r""",
)
def w_hash_groups(t):
    """Neighbouring segments grouped by the hashes of their representatives, at most 90 seconds (W16, W17, W18). As no table has frames, the minute of a sample stands for its picture."""
    from ..operators.signals import representatives

    g = cut_lineage(w_adaptive_segments(t))
    rep = representatives(g, vision(t).select("asset_id", "ts", "sample_id", "ae"), "asset_id", "segment_id", ("start", "end"), "ts", "sample_id", "ae").select("asset_id", "segment_id", "ts")
    h = F.substring(F.md5(F.floor(F.col("ts") / 60).cast("long").cast("string")), 1, 16)
    x = g.join(rep, ["asset_id", "segment_id"], "left").select("asset_id", "segment_id", "start", "end", h.alias("h"), (F.col("boundary_reason") == "visual_change").alias("hard"))
    return L.adjacent_groups(x, "asset_id", "segment_id", "start", "end", "h", "hard")


@reg.add(
    "w_caption_split",
    rf"""WITH w AS (SELECT utterance_id, s, e, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM {SPEECH}),
    p AS (SELECT utterance_id, s, e, string_split(list_reduce(ws, lambda a, x: a || CASE WHEN length(regexp_extract(a, '[^
]*$')) + 1 + length(x) <= 42 THEN ' ' ELSE chr(10) END || x), chr(10)) AS ps FROM w WHERE len(ws) > 0),
    q AS (SELECT utterance_id, s, e, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS piece, len(ps) AS n, list_sum(list_transform(ps, lambda x: length(x))) AS total, ps FROM p), r AS (SELECT *, coalesce(list_sum(list_transform(ps[1:piece], lambda x: length(x))), 0) AS upto FROM q),
    m AS (SELECT *, s + (e - s) * upto / total AS a, CASE WHEN piece = n - 1 THEN e ELSE s + (e - s) * (upto + length(text)) / total END AS b FROM r), k AS (SELECT *, greatest(0, CAST(round(CAST(a AS DECIMAL(24,12)) * 1000, 0) AS BIGINT)) AS x, greatest(0, CAST(round(CAST(b AS DECIMAL(24,12)) * 1000, 0) AS BIGINT)) AS y FROM m)
    SELECT utterance_id, piece, printf('%02d:%02d:%02d,%03d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60, x % 1000) AS starts, printf('%02d:%02d:%02d,%03d', y // 3600000, (y // 60000) % 60, (y // 1000) % 60, y % 1000) AS ends, text FROM k""",
)
def w_caption_split(t):
    """Transcript records as captions of at most 42 characters (W26, SNK4)."""
    x = L.split_captions(speech(t), "utterance_id", "s", "e", "text")
    return x.select("utterance_id", "piece", S.srt_time("piece_start").alias("starts"), S.srt_time("piece_end").alias("ends"), "text")


_BEST_CUT = """coalesce(list_sort(list_transform(list_filter(free, lambda m: m >= cur + 4 AND m <= cur + 12 AND e - m >= 1), lambda m: {'d': abs(m - (cur + 8)), 'm': m}))[1].m,
  list_max(list_transform(list_filter(solid, lambda p: p.a < cur + 8 AND cur + 8 < p.b), lambda p: p.b)), cur + 8.0)"""


@reg.add(
    "w_speech_windows",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT asset_id, s, e, xs, xe FROM {ACTIVITY} st JOIN {_EV} USING (asset_id) WHERE s < xe AND e > xs),
    q AS (SELECT *, max(xe) OVER (PARTITION BY asset_id, s ORDER BY xs, xe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p WHERE xe > xs),
    i AS (SELECT *, sum(CASE WHEN m IS NULL OR xs >= m - 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, s ORDER BY xs, xe ROWS UNBOUNDED PRECEDING) AS n FROM q),
    so AS MATERIALIZED (SELECT asset_id, s, min(xs) AS a, max(xe) AS b FROM i GROUP BY asset_id, s, n),
    fr AS (SELECT DISTINCT asset_id, s, xe AS m FROM p WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.asset_id = p.asset_id AND so.s = p.s AND so.a + 0.001 < p.xe AND p.xe < so.b - 0.001)),
    l AS MATERIALIZED (SELECT asset_id, s, max(e) AS e, any_value(coalesce(free, [])) AS free, any_value(solid) AS solid FROM p LEFT JOIN (SELECT asset_id, s, list(m) AS free FROM fr GROUP BY ALL) USING (asset_id, s)
     LEFT JOIN (SELECT asset_id, s, list({{'a': a, 'b': b}}) AS solid FROM so GROUP BY ALL) USING (asset_id, s) GROUP BY asset_id, s),
    r AS (SELECT asset_id, s, e, free, solid, s AS cur, 1 AS k FROM l UNION ALL SELECT asset_id, s, e, free, solid, cut, k + 1 FROM (SELECT *, {_BEST_CUT} AS cut FROM r) WHERE e - cur > 8 AND cut < e AND e - cut >= 1),
    w AS (SELECT asset_id, s, k, e, cur, lead(cur) OVER (PARTITION BY asset_id, s ORDER BY k) AS nxt FROM r)
    SELECT asset_id, s, k AS "window", round(cur, 3) AS "start", round(coalesce(nxt, e), 3) AS "end" FROM w WHERE nxt IS NOT NULL OR e - cur >= 0.05""",
)
def w_speech_windows(t):
    """Windows of speech that cut no span."""
    return L.speech_windows(activity(t), _evidence(t).select("asset_id", "xs", "xe"), "asset_id")


@reg.add("w_storyboard")
def w_storyboard(t):
    """Up to eight diverse samples of each scene."""
    from ..operators.intervals import points_in

    sc = scenes(t).select("asset_id", "scene_id", F.col("s").alias("start"), F.col("e").alias("end"))
    p = points_in(vision(t), sc, "asset_id", "ts", ("start", "end")).withColumn("h", F.substring(F.md5(F.col("sample_id").cast("string")), 1, 16))
    return L.storyboard(p, ["scene_id"], "ts", "ae", "h", "sample_id")


_SCENE_SAMPLES = f"""(SELECT scene_id, ts AS "timestamp", ae AS confidence, lpad(CAST(sample_id AS VARCHAR), 18, '0') AS source_id FROM {VISION} v JOIN (SELECT scene_id, asset_id, s, e, max(e) OVER (PARTITION BY asset_id) AS z FROM {SCENES}) c USING (asset_id) WHERE ts >= s AND (ts < e OR (e = z AND ts = e)) AND ae IS NOT NULL AND coalesce(fd, 0.0) >= 0.05)"""


@reg.add("w_spaced_selection", f"""SELECT scene_id, CAST(source_id AS BIGINT) AS sample_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY confidence DESC, "timestamp", source_id) AS place FROM {_nms_sql(_SCENE_SAMPLES, "scene_id", 1.0, "<")}) WHERE place <= 3""")
def w_spaced_selection(t):
    """The three best samples of each scene at least a second apart."""
    from ..operators.intervals import points_in

    sc = scenes(t).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))
    return L.spaced_selection(points_in(vision(t), sc, "asset_id", "ts", ("cs", "ce")), ["scene_id"], "ts", "ae", "fd", "sample_id", least_feature=0.05)


@reg.add("v_sign_confidence", f"""{_v("sign_confidence", "line_id", "confident line without text")} FROM {OCR} WHERE trim(coalesce(text, '')) = '' AND conf > 0.5""")
def v_sign_confidence(t):
    """Sign lines must have a text where they are sure of it."""
    return C.violations(ocr(t), "sign_confidence", "asset_id", "line_id", (F.trim(F.coalesce("text", F.lit(""))) == "") & (F.col("conf") > 0.5), "confident line without text")
