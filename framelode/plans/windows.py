"""Order-dependent operators (W1-W7, W11-W30) and the flagship fusion of signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ordered as O
from ..operators import signals as G
from ..session import cut_lineage
from .common import OCR, SCENES, SPEECH, VISION, ocr, rd, scenes, speech, vision
from .joins import ACTIVITY, activity
from .registry import Registry

reg = Registry()


@reg.add(
    "w_lag_delta",
    f"""WITH x AS (SELECT sample_id, fd, lag(fd) OVER w AS p, row_number() OVER w AS k FROM {VISION} WINDOW w AS (PARTITION BY asset_id ORDER BY ts, sample_id)) SELECT sample_id, {rd("abs(fd - p)", 6)} AS delta FROM x WHERE k > 2 AND fd IS NOT NULL AND p IS NOT NULL""",
)
def w_lag_delta(t):
    return G.deltas(vision(t).select("asset_id", "sample_id", "ts", "fd"), "asset_id", "ts", "sample_id", "fd").select("sample_id", S.round_dec("delta", 6).alias("delta"))


@reg.add(
    "w_vector_distance",
    f"""WITH x AS (SELECT vec_id, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, {rd("sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(v[i] - p[i] AS DOUBLE) * CAST(v[i] - p[i] AS DOUBLE))))", 6)} AS distance FROM x WHERE p IS NOT NULL""",
)
def w_vector_distance(t):
    return G.vector_steps(t.embeddings, "label", "vec_id", "embedding").filter("distance IS NOT NULL").select("vec_id", S.round_dec("distance", 6).alias("distance"))


@reg.add(
    "w_quality_change",
    f"""WITH x AS (SELECT sample_id, ae, is_utility u, lag(ae) OVER w AS pa, lag(is_utility) OVER w AS pu, row_number() OVER w AS k FROM {VISION} WINDOW w AS (PARTITION BY asset_id ORDER BY ts, sample_id)),
    y AS (SELECT sample_id, u IS DISTINCT FROM pu AS flip, coalesce({rd("abs(ae - pa)", 6)}, 0.0) AS d FROM x WHERE k > 1) SELECT sample_id, flip, {rd("least(0.85, 0.55 + d * 0.6)", 4)} AS confidence FROM y WHERE flip OR d >= 0.25""",
)
def w_quality_change(t):
    """Samples whose utility flips or whose score moves by a quarter."""
    x = G.changes(vision(t), "asset_id", "ts", "sample_id", ["ae", "is_utility"])
    d = F.coalesce(S.round_dec(F.abs(F.col("ae") - F.col("before.ae")), 6), F.lit(0.0))
    x = x.select("asset_id", "ts", "sample_id", (~F.col("is_utility").eqNullSafe(F.col("before.is_utility"))).alias("flip"), d.alias("d")).filter("flip OR d >= 0.25")
    return x.select("sample_id", "flip", S.round_dec(F.least(F.lit(0.85), 0.55 + F.col("d") * 0.6), 4).alias("confidence"))


@reg.add("w_silence_gaps", f"""WITH x AS (SELECT asset_id, e, lead(s) OVER (PARTITION BY asset_id ORDER BY s) AS n FROM {ACTIVITY}) SELECT asset_id, e AS gap_start, n AS gap_end, {rd("(e + n) / 2", 6)} AS "timestamp", {rd("least(0.92, 0.60 + (n - e) / 20)", 4)} AS confidence FROM x WHERE n - e >= 1.2""")
def w_silence_gaps(t):
    return G.gaps(activity(t), "asset_id", "s", "e")


def _presence_sql(col: str) -> str:
    return f"""(WITH x AS (SELECT asset_id, ts, sample_id, CASE WHEN coalesce({col}, 0) > 0 THEN 1 ELSE 0 END AS o FROM {VISION}),
    c AS (SELECT *, CASE WHEN lag(o) OVER w IS DISTINCT FROM o THEN 1 ELSE 0 END AS h FROM x WINDOW w AS (PARTITION BY asset_id ORDER BY ts, sample_id)),
    r AS (SELECT *, sum(h) OVER (PARTITION BY asset_id ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS n FROM c),
    g AS (SELECT asset_id, n, max(o) AS o, count(*) AS samples, arg_min(sample_id, (ts, sample_id)) AS id, min(ts) AS "timestamp" FROM r GROUP BY asset_id, n HAVING count(*) >= 3),
    p AS (SELECT *, lag(o) OVER (PARTITION BY asset_id ORDER BY n) AS po FROM g) SELECT asset_id, "timestamp", id, o = 1 AS present, samples FROM p WHERE po IS NOT NULL AND po <> o)"""


def _presence(t, col: str):
    return G.stable_presence(t.once("vision", vision), "asset_id", "ts", "sample_id", col, least=3)


@reg.add("w_presence_runs", f"SELECT * FROM {_presence_sql('face_count')}")
def w_presence_runs(t):
    return _presence(t, "face_count")


_WORDS = rf"""(SELECT asset_id, ts, list_sort(list(DISTINCT w)) AS words FROM (SELECT asset_id, ts, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1)) AS w FROM {OCR} WHERE conf >= 0.35) WHERE length(w) >= 2 GROUP BY ALL)"""


def _sign_words(t):
    w = ocr(t).filter("conf >= 0.35").select("asset_id", "ts", F.explode(S.tokens("text")).alias("w"))
    return w.groupBy("asset_id", "ts").agg(F.array_sort(F.collect_set("w")).alias("words"))


_WORD_CHANGES = f"""(WITH n AS (SELECT asset_id, ts, words, lead(words) OVER (PARTITION BY asset_id ORDER BY ts) AS nw FROM {_WORDS}), k AS (SELECT asset_id, ts, list_intersect(words, nw) AS l FROM n WHERE nw IS NOT NULL),
    p AS (SELECT *, lag(l) OVER (PARTITION BY asset_id ORDER BY ts) AS pl FROM k), q AS (SELECT asset_id, ts, len(list_distinct(list_concat(l, pl))) AS u, len(list_intersect(l, pl)) AS i FROM p WHERE pl IS NOT NULL)
    SELECT asset_id, ts AS "timestamp", {rd("i / u", 4)} AS similarity FROM q WHERE u > 0 AND i / u < 0.35)"""


@reg.add("w_sign_persistence", f"SELECT * FROM {_WORD_CHANGES}")
def w_sign_persistence(t):
    """Changes of the sign words that last over two samples."""
    return G.persistent_words(_sign_words(t), "asset_id", "ts", "words")


@reg.add(
    "w_percentile_rank",
    f"""SELECT sample_id, {rd("CASE WHEN max(fd) OVER (PARTITION BY asset_id) - min(fd) OVER (PARTITION BY asset_id) <= 0.001 THEN 0.5 ELSE cume_dist() OVER (PARTITION BY asset_id ORDER BY fd) END", 6)} AS rank FROM {VISION} WHERE fd IS NOT NULL""",
)
def w_percentile_rank(t):
    return G.percentile_rank(vision(t).filter("fd IS NOT NULL"), "asset_id", "fd").select("sample_id", S.round_dec("rank", 6).alias("rank"))


_THR = f"(SELECT asset_id, greatest(0.08, coalesce({rd('quantile_cont(fd, 0.88)', 9)}, 0.0)) AS threshold FROM {VISION} GROUP BY asset_id)"


@reg.add("w_adaptive_threshold", f"SELECT * FROM {_THR}")
def w_adaptive_threshold(t):
    """A quantile of each asset's feature distances, with a floor."""
    return G.quantiles(vision(t), "asset_id", "fd", 0.88, floor=0.08)


_VISUAL = f"""(SELECT v.asset_id, {rd("ts", 6)} AS "timestamp", 'visual_change' AS kind, {rd("least(0.96, 0.52 + 0.35 * fd / greatest(threshold, 0.01))", 4)} AS confidence, 'VISION-FEATURE-' || sample_id AS source_id FROM {VISION} v JOIN {_THR} USING (asset_id) WHERE fd >= threshold AND ts > 0.001)"""


def visual_events(t):
    v = t.once("vision", vision)
    v = v.join(G.quantiles(v, "asset_id", "fd", 0.88, floor=0.08), "asset_id").filter("fd >= threshold AND ts > 0.001")
    return v.select("asset_id", *G.event("visual_change", F.col("ts"), F.least(F.lit(0.96), 0.52 + 0.35 * F.col("fd") / F.greatest(F.col("threshold"), F.lit(0.01))), F.concat(F.lit("VISION-FEATURE-"), F.col("sample_id").cast("string"))))


_AE_THR = f"(SELECT asset_id, greatest(0.12, coalesce({rd('quantile_cont(ae, 0.82)', 9)}, 0.0)) AS aet FROM {VISION} GROUP BY 1)"
_RANKS = "(SELECT asset_id, sample_id, CASE WHEN max({c}) OVER (PARTITION BY asset_id) - min({c}) OVER (PARTITION BY asset_id) <= 0.001 THEN 0.5 ELSE cume_dist() OVER (PARTITION BY asset_id ORDER BY {c}) END AS {n} FROM {v} WHERE {c} IS NOT NULL)"


@reg.add(
    "m_role_scores",
    f"""WITH x AS (SELECT v.*, coalesce(ar, 0.0) AS a, coalesce(fr, 0.0) AS f, coalesce(ae >= aet, FALSE) OR coalesce(fd >= threshold, FALSE) OR coalesce(is_utility, FALSE) AS visual,
     coalesce(face_count > 0, FALSE) OR coalesce(person_count > 0, FALSE) AS people FROM {VISION} v JOIN (SELECT DISTINCT asset_id, duration FROM assets) d USING (asset_id) JOIN {_AE_THR} q USING (asset_id) JOIN {_THR} h USING (asset_id)
     LEFT JOIN {_RANKS.format(c="ae", n="ar", v=VISION)} r USING (asset_id, sample_id) LEFT JOIN {_RANKS.format(c="fd", n="fr", v=VISION)} s USING (asset_id, sample_id) WHERE ts > 0.001 AND ts < duration - 0.001),
    y AS (SELECT *, people AND a >= 0.62 AS candid, 0.58 * a + 0.27 * f + 0.15 AS vs, CASE WHEN people AND a >= 0.62 THEN 0.42 * a + 0.15 * f + 0.20 ELSE 0.0 END AS cs FROM x)
    SELECT asset_id, sample_id, CASE WHEN visual AND candid THEN 'visual,candid' WHEN visual THEN 'visual' ELSE 'candid' END AS roles, CASE WHEN visual AND NOT (candid AND cs > vs) THEN 'visual' ELSE 'candid' END AS primary_role,
    {rd("least(1.0, greatest(vs, cs, CASE WHEN is_utility THEN 0.72 ELSE 0.0 END))", 6)} AS score FROM y WHERE visual OR candid""",
)
def m_role_scores(t):
    """Roles and seed score of the samples that stand out (M8). No table holds motion, so its rank is 0 and no sample has the role action."""
    all_ = t.once("vision", vision)
    v = all_.join(t.assets.select("asset_id", "duration").distinct(), "asset_id")
    v = v.join(G.quantiles(all_, "asset_id", "ae", 0.82, floor=0.12, name="at"), "asset_id").join(G.quantiles(all_, "asset_id", "fd", 0.88, floor=0.08), "asset_id")
    v = v.join(G.percentile_ranks(all_, "asset_id", "ae", "ar"), ["asset_id", "ae"], "left").join(G.percentile_ranks(all_, "asset_id", "fd", "fr"), ["asset_id", "fd"], "left")
    v = v.filter((F.col("ts") > 0.001) & (F.col("ts") < F.col("duration") - 0.001))
    yes = lambda c: F.coalesce(c, F.lit(False))
    v = v.withColumns({"a": F.coalesce("ar", F.lit(0.0)), "f": F.coalesce("fr", F.lit(0.0)), "utility": yes(F.col("is_utility"))})
    v = v.withColumns({"visual": yes(F.col("ae") >= F.col("at")) | yes(F.col("fd") >= F.col("threshold")) | F.col("utility"), "candid": (yes(F.col("face_count") > 0) | yes(F.col("person_count") > 0)) & (F.col("a") >= 0.62)})
    v = v.filter("visual OR candid").withColumns({"vs": 0.58 * F.col("a") + 0.27 * F.col("f") + 0.15, "cs": F.when(F.col("candid"), 0.42 * F.col("a") + 0.15 * F.col("f") + 0.20).otherwise(0.0)})
    roles = F.array_join(F.array_compact(F.array(F.when(F.col("visual"), "visual"), F.when(F.col("candid"), "candid"))), ",")
    first = F.when(F.col("visual") & ~(F.col("candid") & (F.col("cs") > F.col("vs"))), "visual").otherwise("candid")
    score = F.least(F.lit(1.0), F.greatest("vs", "cs", F.when(F.col("utility"), 0.72).otherwise(0.0)))
    return v.select("asset_id", "sample_id", roles.alias("roles"), first.alias("primary_role"), S.round_dec(score, 6).alias("score"))


_EVENT_T = "STRUCT(_t DOUBLE, _s DOUBLE, _id VARCHAR)[]"


def _nms_sql(events: str, keys: str, tol: float, op: str = "<=", score: str = "confidence") -> str:
    """Greedy suppression in SQL: each round keeps the best event left of a key and drops what is near it."""
    return f"""(WITH RECURSIVE ev AS MATERIALIZED (SELECT {keys}, "timestamp" AS _t, {score} AS _s, source_id AS _id, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, "timestamp", source_id) AS rn FROM {events}),
    l AS MATERIALIZED (SELECT {keys}, list({{'_t': _t, '_s': _s, '_id': _id}} ORDER BY rn) AS xs FROM ev GROUP BY {keys}),
    r AS (SELECT {keys}, xs, CAST([] AS {_EVENT_T}) AS kept FROM l UNION ALL SELECT {keys}, list_filter(xs, lambda x: NOT abs(x._t - xs[1]._t) {op} {tol}), list_append(kept, xs[1]) FROM r WHERE len(xs) > 0)
    SELECT {keys}, k._t AS "timestamp", k._s AS {score}, k._id AS source_id FROM (SELECT {keys}, unnest(kept) AS k FROM r WHERE len(xs) = 0))"""


@reg.add("w_nms", f"SELECT * FROM {_nms_sql(_VISUAL, 'asset_id, kind', 0.667)}")
def w_nms(t):
    """Visual changes that no better one lies near."""
    return O.suppress(visual_events(t), ["asset_id", "kind"], "timestamp", "confidence", "source_id", 0.667)


def _weights(x: str = "kind") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in O.KIND_WEIGHTS.items()) + f" ELSE {O.OTHER_WEIGHT} END"


_SPEECH_EVENTS = f"""(SELECT asset_id, {rd("s", 6)} AS "timestamp", 'speech_start' AS kind, 0.74 AS confidence, 'A' || CAST(CAST(round(s * 1000) AS BIGINT) AS VARCHAR) || '-START' AS source_id FROM {ACTIVITY} WHERE s > 0.001
 UNION ALL SELECT asset_id, {rd("e", 6)}, 'speech_end', 0.74, 'A' || CAST(CAST(round(s * 1000) AS BIGINT) AS VARCHAR) || '-END' FROM {ACTIVITY}
 UNION ALL SELECT asset_id, "timestamp", 'silence_gap', confidence, 'SILENCE-' || CAST(CAST(round(gap_start * 1000) AS BIGINT) AS VARCHAR) FROM (WITH x AS (SELECT asset_id, e, lead(s) OVER (PARTITION BY asset_id ORDER BY s) AS n FROM {ACTIVITY}) SELECT asset_id, e AS gap_start, {rd("(e + n) / 2", 6)} AS "timestamp", {rd("least(0.92, 0.60 + (n - e) / 20)", 4)} AS confidence FROM x WHERE n - e >= 1.2)
 UNION ALL SELECT asset_id, {rd("e", 6)}, 'speech_segment_boundary', {rd("0.35 + 0.25 * coalesce(conf, 0.5)", 4)}, utterance_id || '-END' FROM {SPEECH} a WHERE EXISTS (SELECT 1 FROM {SPEECH} b WHERE b.asset_id = a.asset_id AND b.requested_locale <> a.requested_locale AND abs(b.e - a.e) <= 0.35))"""


def speech_events(t):
    """Starts and ends of speech, pauses, and segment ends that two locales agree on."""
    from .joins import j_consensus

    a = t.once("activity", activity)
    name = F.round(F.col("s") * 1000).cast("long").cast("string")
    starts = a.filter("s > 0.001").select("asset_id", *G.event("speech_start", F.col("s"), F.lit(0.74), F.concat(F.lit("A"), name, F.lit("-START"))))
    ends = a.select("asset_id", *G.event("speech_end", F.col("e"), F.lit(0.74), F.concat(F.lit("A"), name, F.lit("-END"))))
    g = G.gaps(a, "asset_id", "s", "e")
    pauses = g.select("asset_id", *G.event("silence_gap", F.col("timestamp"), F.col("confidence"), F.concat(F.lit("SILENCE-"), F.round(F.col("gap_start") * 1000).cast("long").cast("string"))))
    both = t.once("speech", speech).join(j_consensus(t).distinct(), "utterance_id", "left_semi")
    marks = both.select("asset_id", *G.event("speech_segment_boundary", F.col("e"), 0.35 + 0.25 * F.coalesce("conf", F.lit(0.5)), F.concat("utterance_id", F.lit("-END"))))
    return starts.unionByName(ends).unionByName(pauses).unionByName(marks)


_SAMPLE_EVENTS = f"""(SELECT asset_id, "timestamp", 'face_presence_change' AS kind, 0.68 AS confidence, 'VISION-FACE-' || id AS source_id FROM {_presence_sql("face_count")}
 UNION ALL SELECT asset_id, "timestamp", 'person_presence_change', 0.68, 'VISION-PERSON-' || id FROM {_presence_sql("person_count")}
 UNION ALL SELECT asset_id, "timestamp", 'ocr_change', {rd("least(0.87, 0.58 + (1 - similarity) * 0.25)", 4)}, 'VISION-OCR-' || CAST(CAST(round("timestamp" * 1000) AS BIGINT) AS VARCHAR) FROM {_WORD_CHANGES})"""


def sample_events(t):
    """Changes of faces, persons and lasting sign words as events."""
    out = None
    for col, kind, prefix in (("face_count", "face_presence_change", "VISION-FACE-"), ("person_count", "person_presence_change", "VISION-PERSON-")):
        e = _presence(t, col).select("asset_id", *G.event(kind, F.col("timestamp"), F.lit(0.68), F.concat(F.lit(prefix), F.col("id").cast("string"))))
        out = e if out is None else out.unionByName(e)
    w = G.persistent_words(_sign_words(t), "asset_id", "ts", "words")
    return out.unionByName(w.select("asset_id", *G.event("ocr_change", F.col("timestamp"), F.least(F.lit(0.87), 0.58 + (1 - F.col("similarity")) * 0.25), F.concat(F.lit("VISION-OCR-"), F.round(F.col("timestamp") * 1000).cast("long").cast("string")))))


_ALL_EVENTS = f"""(SELECT asset_id, "timestamp", kind, confidence, source_id FROM {_SPEECH_EVENTS} UNION ALL SELECT asset_id, "timestamp", kind, confidence, source_id FROM {_nms_sql(_VISUAL, "asset_id, kind", 0.667)} UNION ALL SELECT asset_id, "timestamp", kind, confidence, source_id FROM {_SAMPLE_EVENTS})"""


def all_events(t):
    visual = O.suppress(visual_events(t), ["asset_id", "kind"], "timestamp", "confidence", "source_id", 0.667)
    return speech_events(t).unionByName(visual).unionByName(sample_events(t))


@reg.add("w_signal_events", f"SELECT * FROM {_ALL_EVENTS}")
def w_signal_events(t):
    """All families of signal events in one table."""
    return all_events(t)


_WEIGHTED = f"(SELECT *, {rd(f'confidence * ({_weights()})', 6)} AS weighted FROM {_ALL_EVENTS})"
_KEPT = f"(SELECT w.* FROM {_WEIGHTED} w JOIN {_nms_sql(_WEIGHTED, 'asset_id', 0.55, '<=', 'weighted')} k ON k.asset_id = w.asset_id AND k.source_id = w.source_id)"


def weighted_events(t):
    """Events that no event of greater weight lies near."""
    e = cut_lineage(all_events(t)).withColumn("weighted", S.round_dec(F.col("confidence") * O.kind_weight("kind"), 6))
    kept = O.suppress(e, ["asset_id"], "timestamp", "weighted", "source_id", 0.55)
    return e.join(kept.select("asset_id", "source_id"), ["asset_id", "source_id"], "left_semi")


@reg.add("w_weighted_nms", f"SELECT asset_id, source_id, weighted FROM {_KEPT}")
def w_weighted_nms(t):
    return weighted_events(t).select("asset_id", "source_id", "weighted")


@reg.add(
    "w_topk_nms",
    f"""WITH k AS (SELECT * FROM {_nms_sql(_VISUAL, "asset_id", 3.0, "<")}), r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, "timestamp", source_id) AS rank FROM k),
    l AS (SELECT DISTINCT asset_id, greatest(1, CAST(ceil(coalesce(duration, 60) / 60.0 * 4) AS BIGINT)) AS lim FROM assets) SELECT r.asset_id, source_id, rank FROM r JOIN l USING (asset_id) WHERE rank <= lim""",
)
def w_topk_nms(t):
    """The best visual changes at least three seconds apart, four a minute."""
    lim = t.assets.select("asset_id", F.greatest(F.lit(1), F.ceil(F.coalesce("duration", F.lit(60.0)) / 60.0 * 4)).cast("long").alias("lim")).distinct()
    return O.best_spaced(visual_events(t).join(lim, "asset_id"), ["asset_id"], "timestamp", "confidence", "source_id", 3.0, "lim").select("asset_id", "source_id", "rank")


_CLUSTERS = f"""(WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp", source_id) AS rn FROM {_KEPT}),
 r AS (SELECT asset_id, rn, source_id, "timestamp", kind, confidence, "timestamp" AS anchor, 1 AS cluster, kind = 'speech_start' AS hs, kind = 'speech_end' AS he FROM e WHERE rn = 1
 UNION ALL SELECT e.asset_id, e.rn, e.source_id, e."timestamp", e.kind, e.confidence, CASE WHEN b THEN e."timestamp" ELSE anchor END, cluster + CASE WHEN b THEN 1 ELSE 0 END, e.kind = 'speech_start' OR (NOT b AND hs), e.kind = 'speech_end' OR (NOT b AND he)
 FROM (SELECT r.*, n.source_id AS ns, (n."timestamp" - r.anchor > 2.0) OR (n.kind = 'speech_start' AND r.he) OR (n.kind = 'speech_end' AND r.hs) AS b FROM r JOIN e n ON n.asset_id = r.asset_id AND n.rn = r.rn + 1) q JOIN e ON e.asset_id = q.asset_id AND e.rn = q.rn + 1)
 SELECT asset_id, source_id, "timestamp", kind, confidence, cluster FROM r)"""


@reg.add("w_anchored_clusters", f"SELECT asset_id, source_id, CAST(cluster AS BIGINT) AS cluster FROM {_CLUSTERS}")
def w_anchored_clusters(t):
    """Events clustered from an anchor, opposed ends of speech kept apart."""
    return O.anchored_clusters(weighted_events(t), ["asset_id"], "timestamp", "source_id", 2.0, kind="kind").select("asset_id", "source_id", "cluster")


@reg.add(
    "flagship_boundary_fusion",
    f"""WITH c AS (SELECT *, {_weights()} AS w FROM {_CLUSTERS}),
    f AS (SELECT asset_id, cluster, arg_max("timestamp", (confidence * w, -"timestamp")) AS "timestamp", arg_max(kind, (confidence * w, -"timestamp")) AS primary_kind, {rd("least(0.99, 1 - exp(sum(ln(1 - least(0.95, confidence * least(1.0, w))))))", 4)} AS confidence, count(*) AS evidence FROM c GROUP BY asset_id, cluster),
    d AS (SELECT *, CAST(round(CAST("timestamp" AS DECIMAL(24,12)) * 1000000) AS BIGINT) AS us FROM f), j AS (SELECT *, us % 1000 AS res, us // 1000 - row_number() OVER (PARTITION BY asset_id, us % 1000 ORDER BY cluster) AS lead, row_number() OVER (PARTITION BY asset_id, us % 1000 ORDER BY cluster) AS j FROM d),
    g AS (SELECT asset_id, {rd("((max(lead) OVER (PARTITION BY asset_id, res ORDER BY cluster ROWS UNBOUNDED PRECEDING) + j) * 1000 + res) / 1000000.0", 6)} AS "timestamp", confidence, primary_kind, evidence FROM j QUALIFY confidence >= 0.60)
    SELECT asset_id, 'BP' || lpad(CAST(row_number() OVER (PARTITION BY asset_id ORDER BY "timestamp") AS VARCHAR), 4, '0') AS proposal_id, "timestamp", confidence, primary_kind, evidence FROM g""",
)
def flagship_boundary_fusion(t):
    """Boundary proposals fused from speech, visual, presence and sign signals."""
    return O.fused_proposals(weighted_events(t), ["asset_id"], 2.0)


_CUT = f"(SELECT asset_id, ts AS t, max(coalesce(fd, 0.0)) AS c, max(d) AS d FROM {VISION} JOIN (SELECT DISTINCT asset_id, duration AS d FROM assets WHERE duration IS NOT NULL) USING (asset_id) GROUP BY ALL)"


ADAPTIVE = f"""(WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY t) AS rn FROM {_CUT}),
    r AS (SELECT asset_id, rn, t, d, CAST(0.0 AS DOUBLE) AS last, CAST(NULL AS VARCHAR) AS reason FROM s WHERE rn = 1
     UNION ALL SELECT n.asset_id, n.rn, n.t, n.d, CASE WHEN n.t < n.d AND ((n.t - r.last >= 5 AND n.c >= 0.6) OR n.t - r.last >= 15) THEN n.t ELSE r.last END,
      CASE WHEN n.t < n.d THEN CASE WHEN n.t - r.last >= 5 AND n.c >= 0.6 THEN 'visual_change' WHEN n.t - r.last >= 15 THEN 'max_duration' END END FROM r JOIN s n ON n.asset_id = r.asset_id AND n.rn = r.rn + 1),
    b AS (SELECT DISTINCT asset_id, CAST(0.0 AS DOUBLE) AS t, 'asset_start' AS reason, d FROM s UNION ALL SELECT asset_id, t, reason, d FROM r WHERE reason IS NOT NULL),
    k AS (SELECT *, lead(t) OVER (PARTITION BY asset_id ORDER BY t) IS NULL AS final FROM b), f AS (SELECT * FROM k WHERE NOT (final AND t > 0 AND d - t < 5))
    SELECT asset_id, 'S' || lpad(CAST(row_number() OVER (PARTITION BY asset_id ORDER BY t) AS VARCHAR), 3, '0') AS segment_id, {rd("t", 3)} AS "start", {rd("coalesce(lead(t) OVER (PARTITION BY asset_id ORDER BY t), d)", 3)} AS "end", reason AS boundary_reason FROM f)"""


@reg.add("w_adaptive_segments", f"SELECT * FROM {ADAPTIVE}")
def w_adaptive_segments(t):
    """Segments cut at strong changes, at least 5 and at most about 15 seconds long."""
    d = t.assets.select("asset_id", "duration").filter("duration IS NOT NULL").distinct()
    return O.adaptive_segments(vision(t).join(d, "asset_id"), "asset_id", "ts", "fd", "duration", shortest=5.0, longest=15.0, threshold=0.6)


@reg.add(
    "w_representatives",
    f"""WITH c AS (SELECT scene_id, asset_id, s, e FROM {SCENES}), p AS (SELECT scene_id, sample_id, ts, {rd("coalesce(ae, 0.0) - 0.12 * abs(ts - (s + e) / 2) / greatest(1.0, e - s)", 9)} AS score FROM {VISION} JOIN c USING (asset_id) WHERE ts >= s AND ts < e),
    i AS (SELECT scene_id, arg_min(sample_id, (-score, ts, sample_id)) AS sample_id FROM p GROUP BY 1), o AS (SELECT scene_id, arg_min(sample_id, (abs(ts - (s + e) / 2), ts, sample_id)) AS sample_id FROM c JOIN {VISION} USING (asset_id) WHERE scene_id NOT IN (SELECT scene_id FROM i) GROUP BY 1)
    SELECT scene_id, sample_id, TRUE AS inside FROM i UNION ALL SELECT scene_id, sample_id, FALSE FROM o""",
)
def w_representatives(t):
    """The sample that shows a scene best: score less its distance from the middle, or the nearest to the middle where none is inside."""
    sc = scenes(t).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))
    return G.representatives(sc, vision(t).select("asset_id", "ts", "sample_id", "ae"), "asset_id", "scene_id", ("cs", "ce"), "ts", "sample_id", "ae").select("scene_id", "sample_id", "inside")


@reg.add(
    "w_context_expand",
    f"""WITH x AS (SELECT utterance_id, coalesce(conf, 0.0) < 0.7 AS u, text, lag(coalesce(conf, 0.0) < 0.7) OVER w AS pu, lead(coalesce(conf, 0.0) < 0.7) OVER w AS nu FROM {SPEECH} WINDOW w AS (PARTITION BY asset_id, requested_locale ORDER BY s, utterance_id))
    SELECT utterance_id, u OR coalesce(pu, FALSE) OR coalesce(nu, FALSE) AS uncertain FROM x""",
)
def w_context_expand(t):
    """Doubt spreads to both neighbours, by the first flags only."""
    from ..operators.sequence import with_next, with_previous

    k, o = ["asset_id", "requested_locale"], ["s", "utterance_id"]
    x = O.with_bucket(speech(t).withColumn("u", F.coalesce("conf", F.lit(0.0)) < 0.7), "s")
    x = with_next(with_previous(x, k, "_b", o, ["u"], "p"), k, "_b", o, ["u"], "n")
    return x.select("utterance_id", (F.col("u") | F.coalesce("p.u", F.lit(False)) | F.coalesce("n.u", F.lit(False))).alias("uncertain"))


@reg.add(
    "w_timeline_layout",
    f"""WITH x AS (SELECT asset_id, scene_id, s, (e - s) / (CASE WHEN highlighted THEN 0.5 ELSE 2.0 END) AS len, CASE WHEN notable_count > 1 THEN 0.25 ELSE 0.0 END AS tr, row_number() OVER w AS k, lead(scene_id) OVER w IS NULL AS final FROM {SCENES} WINDOW w AS (PARTITION BY asset_id ORDER BY s, scene_id)),
    y AS (SELECT *, sum(len - CASE WHEN final THEN 0 ELSE tr END) OVER (PARTITION BY asset_id ORDER BY s, scene_id ROWS UNBOUNDED PRECEDING) - (len - CASE WHEN final THEN 0 ELSE tr END) AS out_start FROM x) SELECT scene_id, {rd("out_start", 4)} AS out_start, {rd("out_start + len", 4)} AS out_end FROM y""",
)
def w_timeline_layout(t):
    """Places of clips on the output timeline, transitions overlapping."""
    from ..operators.sequence import with_next, with_running_sum

    k, o = ["asset_id"], ["s", "scene_id"]
    x = with_next(O.with_bucket(scenes(t), "s"), k, "_b", o, ["scene_id"], "n")
    x = x.withColumns({"len": (F.col("e") - F.col("s")) / F.when(F.col("highlighted"), 0.5).otherwise(2.0), "tr": F.when((F.col("notable_count") > 1) & F.col("n").isNotNull(), 0.25).otherwise(0.0)})
    x = with_running_sum(x.withColumn("own", F.col("len") - F.col("tr")), k, "_b", o, "own", "upto")
    x = x.withColumn("out_start", F.col("upto") - F.col("own"))
    return x.select("scene_id", S.round_dec("out_start", 4).alias("out_start"), S.round_dec(F.col("out_start") + F.col("len"), 4).alias("out_end"))


@reg.add("w_sequential_ids", f"""SELECT scene_id, 'RW' || lpad(CAST(row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS VARCHAR), 4, '0') AS window_id FROM {SCENES}""")
def w_sequential_ids(t):
    """Numbered ids in order of time within an asset."""
    from ..operators.sequence import with_row_number

    x = with_row_number(O.with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "scene_id"], "k")
    return x.select("scene_id", S.sequential_id("RW", 4, "k").alias("window_id"))


@reg.add("w_chronology", f"""WITH x AS (SELECT asset_id, scene_id, s, lag(e) OVER (PARTITION BY asset_id ORDER BY s, e, scene_id) AS pe FROM {SCENES}) SELECT asset_id, scene_id, 'overlaps_previous' AS problem FROM x WHERE s < pe - 0.001""")
def w_chronology(t):
    """Scenes that begin before the one before them ends."""
    from ..operators.sequence import with_previous

    x = with_previous(O.with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "e", "scene_id"], ["e"], "p")
    return x.filter("p IS NOT NULL AND s < p.e - 0.001").select("asset_id", "scene_id", F.lit("overlaps_previous").alias("problem"))


@reg.add(
    "w_neighbour_page",
    """WITH a AS (SELECT DISTINCT asset_id, coalesce(creation_time, '9999') AS c, source_name FROM assets), o AS (SELECT *, row_number() OVER (ORDER BY c, source_name, asset_id) - 1 AS i, count(*) OVER () AS n FROM a), m AS (SELECT i, n FROM o WHERE asset_id = 'A00000010'),
    w AS (SELECT greatest(0, least(n, greatest(0, i - 4) + 8) - 8) AS a, least(n, greatest(0, i - 4) + 8) AS b FROM m) SELECT asset_id, o.i AS place FROM o, w WHERE o.i >= w.a AND o.i < w.b""",
)
def w_neighbour_page(t):
    """Eight assets around one in capture order, clamped at the ends."""
    from ..operators.catalog import nearby

    a = t.assets.select("asset_id", F.coalesce("creation_time", F.lit("9999")).alias("c"), "source_name").distinct()
    return nearby(a, ["c", "source_name", "asset_id"], "asset_id", "A00000010", 8)


@reg.add(
    "w_even_allocation",
    f"""WITH f AS (SELECT asset_id, scene_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM {SCENES}) SELECT scene_id, {rd("s", 6)} AS source_in, {rd("least(e, s + greatest(3.0, least(9.0, 30.0 / least(n, 6))))", 6)} AS source_out FROM f WHERE k <= 6""",
)
def w_even_allocation(t):
    """A target of 30 seconds shared out over an asset's first six scenes."""
    from ..operators.sequence import with_row_number

    n = scenes(t).groupBy("asset_id").agg(F.count("*").alias("n"))
    x = with_row_number(O.with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "scene_id"], "k").filter("k <= 6").join(n, "asset_id")
    return x.select("scene_id", S.round_dec("s", 6).alias("source_in"), S.round_dec(F.least(F.col("e"), F.col("s") + F.greatest(F.lit(3.0), F.least(F.lit(9.0), 30.0 / F.least(F.col("n"), F.lit(6))))), 6).alias("source_out"))
