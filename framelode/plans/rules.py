"""Rules on single rows and on two sides of ids, paths, runs and shards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as Q
from ..operators import intervals as I
from ..operators import matching as M
from ..session import cut_lineage
from .common import SCENES, SPANS, SPEECH, VISION, rd, scenes, spans, speech, vision
from .registry import Registry

reg = Registry()

_STT = "(SELECT DISTINCT asset_id, utterance_id, requested_locale, selected_locale, text, mean_confidence AS conf, is_final FROM stt_candidates)"


def _stt(t):
    return t.stt_candidates.select("asset_id", "utterance_id", "requested_locale", "selected_locale", "text", F.col("mean_confidence").alias("conf"), "is_final").distinct()


@reg.add(
    "p_lexical_split",
    f"""SELECT DISTINCT utterance_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'ignored_empty' WHEN coalesce(selected_locale, 'non_speech') = 'non_speech' OR regexp_full_match(trim(text), '[\\[(*♪<].*[\\])*♪>]') THEN 'ignored_non_speech' ELSE 'lexical' END AS class FROM {_STT}""",
)
def p_lexical_split(t):
    """Records with words of a language, and those kept only for the audit: blank ones and ones that aren't speech."""
    none = (F.coalesce("selected_locale", F.lit("non_speech")) == "non_speech") | F.trim("text").rlike(r"^[\[(*♪<].*[\])*♪>]$")
    return _stt(t).select("utterance_id", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "ignored_empty").when(none, "ignored_non_speech").otherwise("lexical").alias("class")).distinct()


_STATUS = "CASE WHEN conf IS NULL THEN '' WHEN conf >= 0.8 THEN ' Approved' WHEN conf >= 0.6 THEN 'reviewed ' ELSE 'rejected' END"


@reg.add("p_usable", f"""SELECT DISTINCT utterance_id FROM {_STT} WHERE lower(trim({_STATUS})) IN ('approved', 'reviewed') AND is_final IS NOT FALSE""")
def p_usable(t):
    """An accepted status, however written, and not marked unusable; an unknown mark counts as usable (P5). Bands of confidence stand for the status, finality for the mark."""
    status = F.when(F.col("conf").isNull(), "").when(F.col("conf") >= 0.8, " Approved").when(F.col("conf") >= 0.6, "reviewed ").otherwise("rejected")
    return _stt(t).filter(S.accepted_status(status, ["approved", "reviewed"]) & ~F.col("is_final").eqNullSafe(False)).select("utterance_id").distinct()


@reg.add("p_shard", """SELECT asset_id FROM (SELECT asset_id, row_number() OVER (ORDER BY asset_id) AS n FROM (SELECT DISTINCT asset_id FROM assets)) WHERE (n - 1) % 4 = 2""")
def p_shard(t):
    """Shard 3 of 4 of all assets in the order of their ids."""
    return M.shard(t.assets, "asset_id", 3, 4)


_DAY = "CASE WHEN length(creation_time) >= 10 THEN substr(creation_time, 1, 10) ELSE 'unknown' END"


@reg.add(
    "p_day_lists",
    f"""WITH a AS (SELECT DISTINCT asset_id, {_DAY} AS day FROM assets), i AS (SELECT DISTINCT day FROM a WHERE day >= '2025' UNION SELECT '1999-01-01'), x AS (SELECT unnest(['unknown', '1998-01-01']) AS day)
    SELECT asset_id, day, 'kept' AS state FROM a WHERE day IN (SELECT day FROM i) AND day NOT IN (SELECT day FROM x) UNION ALL SELECT NULL, day, 'no such day' FROM (SELECT day FROM i UNION SELECT day FROM x) WHERE day NOT IN (SELECT day FROM a)""",
)
def p_day_lists(t):
    """Days of a list that aren't on another; names on the lists that no asset has are told."""
    a = t.assets.select("asset_id", S.capture_day("creation_time").alias("day")).distinct()
    include = a.filter("day >= '2025'").select("day").distinct().unionByName(t.spark.createDataFrame([("1999-01-01",)], "day string"))
    kept, unknown = M.listed(a, "day", include, t.spark.createDataFrame([("unknown",), ("1998-01-01",)], "day string"))
    return kept.select("asset_id", "day", F.lit("kept").alias("state")).unionByName(unknown.select(F.lit(None).cast("string").alias("asset_id"), "day", F.lit("no such day").alias("state")))


@reg.add(
    "p_recommendations",
    f"""WITH x AS (SELECT scene_id, coalesce(confidence, 0.5) AS i, CASE WHEN contains(label, 'night') THEN 'camera_handling' WHEN contains(label, 'trail') THEN 'transition' ELSE 'place' END AS kind, list_has_any(tags, ['drone', 'train']) AS bad, coalesce(notable_count, 0) > 2 AS k FROM {SCENES})
    SELECT scene_id, CASE WHEN k THEN 'keep' WHEN i <= 0.25 OR kind = 'camera_handling' OR bad THEN 'trim' WHEN i >= 0.72 THEN 'keep' WHEN kind = 'transition' OR i < 0.5 THEN 'bridge' ELSE 'review' END AS advice FROM x""",
)
def p_recommendations(t):
    """What to do with a scene (P12). Confidence stands for importance, words of labels for scene types, two tags for quality flags."""
    kind = F.when(F.col("label").contains("night"), "camera_handling").when(F.col("label").contains("trail"), "transition").otherwise("place")
    bad = F.arrays_overlap("tags", F.array(F.lit("drone"), F.lit("train")))
    return scenes(t).select("scene_id", S.recommendation(F.col("confidence"), kind, bad, F.coalesce("notable_count", F.lit(0)) > 2).alias("advice"))


@reg.add(
    "p_bands",
    f"""SELECT utterance_id, CASE WHEN conf IS NULL THEN 'unknown' WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_band, CASE WHEN l IS NULL THEN 'unknown' WHEN l >= -0.5 THEN 'high' WHEN l >= -0.85 THEN 'medium' ELSE 'low' END AS logprob_band FROM (SELECT *, {rd("ln(nullif(conf, 0))", 6)} AS l FROM {SPEECH})""",
)
def p_bands(t):
    """Bands of confidences and of mean log probabilities."""
    log = S.round_dec(F.log(F.nullif(F.col("conf"), F.lit(0.0))), 6)
    return speech(t).select("utterance_id", S.band("conf", 0.8, 0.65).alias("confidence_band"), S.band(log, -0.5, -0.85).alias("logprob_band"))


@reg.add(
    "p_backoff",
    """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'started' END AS ev FROM events), n AS (SELECT max(ts) AS now FROM events),
    p AS (SELECT user_id, arg_max(ev, (ts, ev)) AS last, max(ts) FILTER (WHERE ev = 'failed') AS failed FROM e GROUP BY 1) SELECT user_id FROM p, n WHERE last <> 'completed' AND (failed IS NULL OR epoch_us(now) - epoch_us(failed) >= 86400000000)""",
)
def p_backoff(t):
    """Jobs to run: not completed since their last start and without a failure within a day (P16, ST1)."""
    from ..streaming.jobs import due

    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("started")
    e = t.events.select("user_id", "ts", kind.alias("ev"))
    return due(t.events.select("user_id").distinct(), e, "user_id", "ts", "ev", t.events.agg(F.max("ts")).first()[0], seconds=86_400)


@reg.add("p_language_counts", f"""SELECT asset_id, count(*) AS n, string_agg(l || '=' || k, ',' ORDER BY l) AS languages FROM (SELECT asset_id, l, count(*) AS k, any_value(n) AS n FROM (SELECT p.asset_id, u.requested_locale AS l, count(*) OVER (PARTITION BY p.asset_id) AS n FROM {SPANS} p JOIN {SPEECH} u USING (asset_id, utterance_id)) GROUP BY ALL) GROUP BY ALL""".replace("SELECT asset_id, count(*) AS n, string", "SELECT asset_id, CAST(sum(k) AS BIGINT) AS n, string"))
def p_language_counts(t):
    """Utterances of an asset's flattened windows by language."""
    j = spans(t).join(speech(t).select("asset_id", "utterance_id", "requested_locale"), ["asset_id", "utterance_id"]).groupBy("asset_id", F.col("requested_locale").alias("l")).agg(F.count("*").alias("k"))
    return j.groupBy("asset_id").agg(F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "l", F.col("k").cast("string")))), ",").alias("languages"))


@reg.add(
    "p_display_signals",
    """WITH x AS (SELECT DISTINCT scene_id, tags, dialogue_excerpt, notable_count, confidence FROM scenes) SELECT scene_id, list_concat(list_transform(list_filter(s, lambda v, i: list_position(s, v) = i), lambda v: v),
     list_concat(CASE WHEN trim(coalesce(dialogue_excerpt, '')) <> '' THEN ['dialogue'] ELSE [] END, list_concat(CASE WHEN notable_count > 0 THEN ['people'] ELSE [] END, CASE WHEN confidence IS NULL OR confidence < 0.5 THEN ['attention'] ELSE [] END))) AS signals
    FROM (SELECT *, list_transform(tags, lambda v: v || CASE length(v) % 3 WHEN 0 THEN '' WHEN 1 THEN ' (said)' ELSE ' (inferred)' END) AS s FROM x)""",
)
def p_display_signals(t):
    """What a scene shows, first occurrences only (P18): subjects with how they are known, then dialogue, people, and whether it needs attention. A tag's length stands for the basis of its claim."""
    x = t.scenes.select("scene_id", "tags", "dialogue_excerpt", "notable_count", "confidence").distinct()
    known = lambda v: F.when(F.length(v) % 3 == 0, "visual").when(F.length(v) % 3 == 1, "speech").otherwise("inferred")
    claims = F.transform("tags", lambda v: F.struct(v.alias("kind"), known(v).alias("basis")))
    return x.select("scene_id", S.display_signals(claims, F.trim(F.coalesce("dialogue_excerpt", F.lit(""))) != "", F.col("notable_count") > 0, F.col("confidence").isNull() | (F.col("confidence") < 0.5)).alias("signals"))


@reg.add("p_cited_rows", f"""WITH p AS (SELECT scene_id, arg_min(sample_id, (ts, sample_id)) AS a, arg_max(sample_id, (ae, -sample_id)) FILTER (WHERE ae IS NOT NULL) AS b FROM {VISION} JOIN {SCENES} USING (asset_id) WHERE ts >= s AND ts < e GROUP BY 1) SELECT DISTINCT sample_id FROM {VISION} WHERE sample_id IN (SELECT unnest([a, b]) FROM p)""")
def p_cited_rows(t):
    """Samples that a scene's representative and key moments cite, here its first and its best one (P20)."""
    sc = scenes(t).select("asset_id", "scene_id", F.col("s").alias("cs"), F.col("e").alias("ce"))
    p = I.points_in(vision(t), sc, "asset_id", "ts", ("cs", "ce")).filter("ts < ce").groupBy("scene_id").agg(F.min_by("sample_id", F.struct("ts", "sample_id")).alias("a"), F.max_by("sample_id", F.when(F.col("ae").isNotNull(), F.struct("ae", (-F.col("sample_id")).alias("n")))).alias("b"))
    return vision(t).join(p.select(F.explode(F.array_compact(F.array("a", "b"))).alias("sample_id")), "sample_id", "left_semi").select("sample_id").distinct()


@reg.add("p_default_review", f"""SELECT a.asset_id, CASE WHEN n IS NULL THEN 'no_speech' ELSE 'refused' END AS status, CASE WHEN n IS NULL THEN 1.0::DOUBLE END AS confidence, coalesce(n, 0) AS windows FROM (SELECT DISTINCT asset_id FROM assets) a LEFT JOIN (SELECT asset_id, count(*) AS n FROM {SPEECH} GROUP BY 1) u USING (asset_id)""")
def p_default_review(t):
    """Fixed answers for assets without any window; assets with windows are refused."""
    n = speech(t).groupBy("asset_id").agg(F.count("*").alias("n"))
    x = t.assets.select("asset_id").distinct().join(n, "asset_id", "left")
    free = F.col("n").isNull()
    return x.select("asset_id", F.when(free, "no_speech").otherwise("refused").alias("status"), F.when(free, 1.0).alias("confidence"), F.coalesce("n", F.lit(0)).alias("windows"))


@reg.add(
    "j_lookups",
    f"""SELECT s.scene_id, a.source_name, c.title AS trip_title, x.first_sample, u.records, d.documents FROM {SCENES} s JOIN (SELECT DISTINCT asset_id, trip_id, source_name FROM assets) a USING (asset_id) LEFT JOIN trip_config c USING (trip_id)
    LEFT JOIN (SELECT asset_id, min(sample_id) AS first_sample FROM vision_samples GROUP BY 1) x USING (asset_id) LEFT JOIN (SELECT asset_id, count(DISTINCT utterance_id) AS records FROM stt_candidates GROUP BY 1) u USING (asset_id) LEFT JOIN (SELECT asset_id, count(*) AS documents FROM documents GROUP BY 1) d USING (asset_id)""",
)
def j_lookups(t):
    """Lookups by id in assets, trips, samples, records and documents."""
    a = t.assets.select("asset_id", "trip_id", "source_name").distinct()
    out = scenes(t).select("scene_id", "asset_id").join(a, "asset_id").join(t.trip_config.select("trip_id", F.col("title").alias("trip_title")), "trip_id", "left")
    for side in (t.vision_samples.groupBy("asset_id").agg(F.min("sample_id").alias("first_sample")), t.stt_candidates.groupBy("asset_id").agg(F.countDistinct("utterance_id").alias("records")), t.documents.groupBy("asset_id").agg(F.count("*").alias("documents"))):
        out = out.join(side, "asset_id", "left")
    return out.select("scene_id", "source_name", "trip_title", "first_sample", "records", "documents")


@reg.add(
    "j_ordered_ids",
    """WITH g AS (SELECT asset_id, group_id, list(scene_id ORDER BY scene_id DESC) AS ids FROM (SELECT DISTINCT asset_id, group_id, scene_id FROM scenes) GROUP BY ALL), x AS (SELECT asset_id, group_id, unnest(ids) AS scene_id, generate_subscripts(ids, 1) AS k FROM g)
    SELECT asset_id, group_id, string_agg(coalesce(label, '?'), '|' ORDER BY k) AS labels FROM x JOIN (SELECT DISTINCT scene_id, label FROM scenes) USING (scene_id) GROUP BY ALL""",
)
def j_ordered_ids(t):
    """The ids of a group looked up in their own order."""
    k = ["asset_id", "group_id"]
    g = t.scenes.select(*k, "scene_id").distinct().groupBy(*k).agg(F.sort_array(F.collect_list("scene_id"), asc=False).alias("ids"))
    x = g.select(*k, F.posexplode("ids").alias("k", "scene_id")).join(t.scenes.select("scene_id", F.coalesce("label", F.lit("?")).alias("label")).distinct(), "scene_id")
    return x.groupBy(*k).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda v: v["label"]), "|").alias("labels"))


@reg.add(
    "j_run_alignment",
    f"""WITH x AS (SELECT asset_id, CAST(floor(s / 60) AS BIGINT) AS minute, requested_locale AS run, list_sort(list(DISTINCT text)) AS v FROM {SPEECH} WHERE requested_locale IS NOT NULL GROUP BY ALL), k AS (SELECT list_sort(list(DISTINCT run)) AS al FROM x),
    b AS (SELECT asset_id, minute, list_sort(list(DISTINCT run)) AS runs, list_sort(list_distinct(flatten(list(v)))) AS vals, count(DISTINCT v) AS n FROM x GROUP BY ALL) SELECT asset_id, minute, runs, list_sort(list_filter(al, lambda r: NOT list_contains(runs, r))) AS missing, vals AS "values", n > 1 OR len(runs) < len(al) AS differ FROM b, k""",
)
def j_run_alignment(t):
    """The runs of all locales minute by minute, what each minute lacks and whether they differ."""
    return M.aligned_runs(speech(t).withColumn("minute", F.floor(F.col("s") / 60).cast("long")), ["asset_id", "minute"], "requested_locale", "text")


@reg.add("j_anti_overlap", f"""SELECT utterance_id FROM {SPEECH} a WHERE NOT EXISTS (SELECT 1 FROM {SPEECH} b WHERE b.asset_id = a.asset_id AND b.requested_locale <> a.requested_locale AND least(a.e, b.e) - greatest(a.s, b.s) > 0.2)""")
def j_anti_overlap(t):
    """Records that no record of another locale overlaps by more than 0.2 s."""
    b = speech(t).select("asset_id", F.col("s").alias("bs"), F.col("e").alias("be"), F.col("requested_locale").alias("bl"))
    hit = I.overlap_join(speech(t), b, "asset_id", ("s", "e"), ("bs", "be"), least=0.2).filter("bl <> requested_locale").select("utterance_id").distinct()
    return speech(t).join(hit, "utterance_id", "left_anti").select("utterance_id")


_ARTIFACTS = "(SELECT DISTINCT asset_id, CASE WHEN scene_count % 2 = 0 THEN source_path ELSE proxy_path END AS path, quick_fingerprint AS fp FROM assets)"


@reg.add("j_lineage", f"""WITH k AS (SELECT source_path AS path, quick_fingerprint AS fp FROM assets WHERE duration > 20 UNION SELECT proxy_path, quick_fingerprint FROM assets WHERE duration > 20) SELECT asset_id, EXISTS (SELECT 1 FROM k WHERE k.path = a.path AND k.fp = a.fp) AS known FROM {_ARTIFACTS} a""")
def j_lineage(t):
    """Artifacts whose path and fingerprint are those of an original or a proxy of the library, here of longer media."""
    art = t.assets.select("asset_id", F.when(F.col("scene_count") % 2 == 0, F.col("source_path")).otherwise(F.col("proxy_path")).alias("path"), F.col("quick_fingerprint").alias("fp")).distinct()
    long = t.assets.filter("duration > 20")
    k = long.select(F.col("source_path").alias("path"), F.col("quick_fingerprint").alias("fp")).unionByName(long.select(F.col("proxy_path").alias("path"), F.col("quick_fingerprint").alias("fp"))).distinct().withColumn("hit", F.lit(True))
    return art.join(k, ["path", "fp"], "left").select("asset_id", F.coalesce("hit", F.lit(False)).alias("known"))


@reg.add(
    "j_suffix_paths",
    """WITH a AS (SELECT DISTINCT asset_id, string_split(lower(proxy_path), '/') AS p FROM assets WHERE proxy_path IS NOT NULL), b AS (SELECT DISTINCT asset_id AS clip_id, trip_id || '/' || regexp_extract(upper(proxy_path), '[^/]+$') AS suffix FROM assets WHERE proxy_path IS NOT NULL)
    SELECT a.asset_id, b.clip_id FROM a JOIN b ON a.p[len(a.p) - 1:] = string_split(lower(b.suffix), '/')""",
)
def j_suffix_paths(t):
    """Proxies and clips that name them by the end of their path, in other case."""
    a = t.assets.filter("proxy_path IS NOT NULL")
    b = a.select(F.col("asset_id").alias("clip_id"), F.concat_ws("/", "trip_id", F.regexp_extract(F.upper("proxy_path"), r"[^/]+$", 0)).alias("suffix")).distinct()
    return M.suffix_matches(a.select("asset_id", "proxy_path").distinct(), "proxy_path", b, "suffix").select("asset_id", "clip_id")


_STEM = "lower(coalesce(trip_id, '') || '/' || regexp_replace(regexp_replace({c}, '^.*/', ''), '\\.[^.]*$', ''))"


@reg.add(
    "j_unique_mapping",
    f"""WITH o AS (SELECT DISTINCT asset_id, trip_id || '/' || regexp_extract(regexp_replace(source_name, '\\.[^.]*$', ''), '[0-9]+$') AS stem FROM assets WHERE source_name IS NOT NULL), p AS (SELECT DISTINCT asset_id, {_STEM.format(c="proxy_path")} AS stem FROM assets WHERE proxy_path IS NOT NULL),
    u AS (SELECT stem, min(asset_id) AS proxy_of FROM p GROUP BY 1 HAVING count(*) = 1) SELECT o.asset_id, u.proxy_of FROM o JOIN u ON u.stem = lower(o.stem)""",
)
def j_unique_mapping(t):
    """Originals and the one proxy of their trip and number; where there are several there is none."""
    bare = F.regexp_extract(F.regexp_replace("source_name", r"\.[^.]*$", ""), r"[0-9]+$", 0)
    o = t.assets.filter("source_name IS NOT NULL").select("asset_id", F.lower(F.concat("trip_id", F.lit("/"), bare)).alias("stem")).distinct()
    p = t.assets.filter("proxy_path IS NOT NULL").select("asset_id", F.lower(F.concat(F.coalesce("trip_id", F.lit("")), F.lit("/"), F.regexp_replace(F.regexp_replace("proxy_path", "^.*/", ""), r"\.[^.]*$", ""))).alias("stem")).distinct()
    return M.only_candidates(o, "stem", p, "stem", "asset_id", "proxy_of").select("asset_id", "proxy_of")


@reg.add(
    "j_overrides",
    f"""WITH d AS (SELECT DISTINCT asset_id, timeline_path AS tl, scene_count > 0 AS ok FROM assets), o AS (SELECT asset_id, count(*) AS n, max(CASE WHEN confidence >= 0.7 THEN '/override/' || scene_id END) AS ov FROM {SCENES} WHERE highlighted GROUP BY 1),
    x AS (SELECT d.asset_id, n, ov, CASE WHEN ok THEN tl END AS df FROM d LEFT JOIN o USING (asset_id)), y AS (SELECT *, CASE WHEN coalesce(n > 1, FALSE) THEN 'overridden twice' WHEN coalesce(ov, df) IS NULL THEN 'no accepted override and no verified default' END AS problem FROM x)
    SELECT asset_id, CASE WHEN problem IS NULL THEN coalesce(ov, df) END AS timeline, CASE WHEN problem IS NULL THEN CASE WHEN ov IS NOT NULL THEN 'override' ELSE 'default' END END AS origin, problem FROM y""",
)
def j_overrides(t):
    """Timelines of assets: an accepted override, else the verified default, else an error (J21). Highlights stand for overrides."""
    d = t.assets.select("asset_id", F.col("timeline_path").alias("timeline"), (F.col("scene_count") > 0).alias("verified")).distinct()
    o = scenes(t).filter("highlighted").select("asset_id", F.concat(F.lit("/override/"), F.col("scene_id")).alias("timeline"), (F.col("confidence") >= 0.7).alias("accepted"))
    return M.overridden(d, o, "asset_id", "timeline")


@reg.add(
    "a_coverage_ratio",
    f"""WITH u AS (SELECT asset_id, utterance_id, length(text) % 23 <> 0 AS cap FROM {SPEECH}) SELECT a.asset_id, {rd("coalesce(count(*) FILTER (WHERE cap) / nullif(count(utterance_id), 0), 1.0)", 6)} AS covered, count(*) FILTER (WHERE NOT cap) AS missing, count(*) FILTER (WHERE NOT cap) = 0 AS passed FROM (SELECT DISTINCT asset_id FROM assets) a LEFT JOIN u USING (asset_id) GROUP BY 1""",
)
def a_coverage_ratio(t):
    """Share of an asset's utterances that captions cite, 1 without any, and whether none is missing (A20, V23). Captions as in ``v_captions``."""
    u = speech(t).select("asset_id", "utterance_id", "text")
    cited = u.filter(F.length("text") % 23 != 0).select("utterance_id").distinct().withColumn("cap", F.lit(True))
    x = t.assets.select("asset_id").distinct().join(u.join(cited, "utterance_id", "left"), "asset_id", "left")
    said = F.count("utterance_id")
    missing = F.count_if(F.col("utterance_id").isNotNull() & F.col("cap").isNull())
    return x.groupBy("asset_id").agg(S.round_dec(F.coalesce(F.count_if("cap") / F.nullif(said, F.lit(0)), F.lit(1.0)), 6).alias("covered"), missing.alias("missing"), (missing == 0).alias("passed"))


@reg.add(
    "a_multiset_equality",
    """WITH l AS (SELECT asset_id, unnest(tags) AS tag FROM (SELECT DISTINCT asset_id, scene_id, tags FROM scenes)), r AS (SELECT asset_id, unnest(tags) AS tag FROM (SELECT DISTINCT asset_id, tags FROM assets)),
    x AS (SELECT asset_id, tag, count(*) AS a, 0 AS b FROM l GROUP BY ALL UNION ALL SELECT asset_id, tag, 0, count(*) FROM r GROUP BY ALL) SELECT asset_id, tag, CAST(sum(a) AS BIGINT) AS "left", CAST(sum(b) AS BIGINT) AS "right" FROM x GROUP BY ALL HAVING sum(a) <> sum(b)""",
)
def a_multiset_equality(t):
    """Tags that an asset and its scenes hold in different numbers."""
    l = t.scenes.select("asset_id", "scene_id", "tags").distinct().select("asset_id", F.explode("tags").alias("tag"))
    r = t.assets.select("asset_id", "tags").distinct().select("asset_id", F.explode("tags").alias("tag"))
    return M.multiset_differences(l, r, ["asset_id", "tag"])


@reg.add(
    "a_language_hint",
    f"""WITH x AS (SELECT asset_id, CAST(floor(s / 8) AS BIGINT) AS win, requested_locale AS l, coalesce(conf, 0.0) AS p, utterance_id FROM {SPEECH}), f AS (SELECT utterance_id, bool_and(is_final) AS fin FROM stt_candidates GROUP BY 1),
    g AS (SELECT asset_id, win, count(DISTINCT l) AS n, min(substr(l, 1, 2)) AS one, count(DISTINCT substr(l, 1, 2)) FILTER (WHERE fin AND p >= 0.8 AND p - (1 - p) >= 0.3) AS sure, min(substr(l, 1, 2)) FILTER (WHERE fin AND p >= 0.8 AND p - (1 - p) >= 0.3) AS which FROM x JOIN f USING (utterance_id) GROUP BY ALL)
    SELECT asset_id, win AS "window", CASE WHEN n = 1 THEN one WHEN sure = 1 THEN which ELSE 'uncertain' END AS language, CASE WHEN n = 1 THEN 'weak' WHEN sure = 1 THEN 'medium' ELSE 'none' END AS confidence FROM g""",
)
def a_language_hint(t):
    """The language hint of windows of eight seconds (A25): a single locale is a weak one, unanimous sure ones (0.8, margin 0.3, final) are medium."""
    fin = t.stt_candidates.groupBy("utterance_id").agg(F.every("is_final").alias("fin"))
    p = F.coalesce("conf", F.lit(0.0))
    x = speech(t).join(fin, "utterance_id").select("asset_id", F.floor(F.col("s") / 8).cast("long").alias("window"), F.col("requested_locale").alias("l"), F.substring("requested_locale", 1, 2).alias("two"), (F.col("fin") & (p >= 0.8) & (p - (1 - p) >= 0.3)).alias("sure"))
    g = x.groupBy("asset_id", "window").agg(F.countDistinct("l").alias("n"), F.min("two").alias("one"), F.countDistinct(F.when(F.col("sure"), F.col("two"))).alias("k"), F.min(F.when(F.col("sure"), F.col("two"))).alias("which"))
    return g.select("asset_id", "window", F.when(F.col("n") == 1, F.col("one")).when(F.col("k") == 1, F.col("which")).otherwise("uncertain").alias("language"), F.when(F.col("n") == 1, "weak").when(F.col("k") == 1, "medium").otherwise("none").alias("confidence"))


@reg.add(
    "u_shard_merge",
    f"""WITH x AS (SELECT asset_id, scene_id, s, row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS place, length(label) AS w FROM {SCENES}), sh AS (SELECT scene_id FROM x WHERE w % 2 = 0 UNION ALL SELECT scene_id FROM x WHERE w % 3 = 0 UNION ALL SELECT scene_id || '-x' FROM x WHERE w % 7 = 0),
    c AS (SELECT scene_id, count(*) AS n FROM sh GROUP BY 1), p AS (SELECT coalesce(x.scene_id, c.scene_id) AS scene_id, place, n FROM x FULL JOIN c ON c.scene_id = x.scene_id)
    SELECT scene_id, place, CASE WHEN n > 1 THEN 'in several shards' WHEN n IS NULL THEN 'in no shard' WHEN place IS NULL THEN 'not expected' END AS problem FROM p""",
)
def u_shard_merge(t):
    """Scenes of two shards and some strange ones, with their place in the packet or what forbids the merge."""
    from ..operators.ordered import with_bucket
    from ..operators.sequence import with_row_number

    x = cut_lineage(with_row_number(with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "scene_id"], "place").select("scene_id", "place", F.length("label").alias("w")))
    parts = x.filter("w % 2 = 0").select("scene_id").unionByName(x.filter("w % 3 = 0").select("scene_id")).unionByName(x.filter("w % 7 = 0").select(F.concat("scene_id", F.lit("-x")).alias("scene_id")))
    merged, problems = M.merged_shards(parts, x, "scene_id", "place")
    out = merged.distinct().join(problems, "scene_id", "full_outer")
    return out.join(x.select("scene_id", F.col("place").alias("at")), "scene_id", "left").select("scene_id", F.coalesce("place", "at").alias("place"), "problem")


@reg.add(
    "t_ranked_search",
    rf"""WITH q AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('Muddy stone bridge'), '([\p{{L}}\p{{N}}_]+)', 1), lambda w: length(w) > 1)) AS toks), s AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(search_text), '([\p{{L}}\p{{N}}_]+)', 1), lambda w: length(w) > 1)) AS st FROM {SCENES}),
    r AS (SELECT scene_id, len(list_intersect(st, toks)) AS o, contains(lower(search_text), lower('Muddy stone bridge')) AS sub, highlighted, notable_count, confidence FROM s, q)
    SELECT scene_id, {rd("o * 2.0 + CASE WHEN sub THEN 2.5 ELSE 0.0 END + CASE WHEN highlighted THEN 0.8 ELSE 0.0 END + least(1.0, coalesce(notable_count, 0) * 0.4) + coalesce(confidence, 0) * 0.25", 6)} AS score FROM r WHERE o > 0 OR sub ORDER BY score DESC, scene_id LIMIT 12""",
)
def t_ranked_search(t):
    """The twelve scenes that fit a query best."""
    return Q.search_scenes(scenes(t), "Muddy stone bridge").select("scene_id", "score")


@reg.add(
    "d_capture_labels",
    """WITH x AS (SELECT DISTINCT asset_id, creation_time AS c, TRY_CAST(replace(regexp_extract(creation_time, '^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)(\\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$', 1), 'T', ' ') AS TIMESTAMP) AS ts, regexp_matches(creation_time, '(Z|[+-]00:?00)$') AS utc FROM assets)
    SELECT asset_id, CASE WHEN coalesce(c, '') = '' THEN 'unknown time' WHEN ts IS NULL THEN c ELSE strftime(ts, '%H:%M') || CASE WHEN utc THEN ' UTC' ELSE '' END END AS label, CASE WHEN coalesce(c, '') = '' THEN 'no capture time' WHEN ts IS NULL THEN 'as written' ELSE strftime(ts, '%Y.%m.%d') END AS detail FROM x""",
)
def d_capture_labels(t):
    """Time and day of capture as lists show them (D3)."""
    label, detail = S.capture_label("creation_time")
    return t.assets.select("asset_id", "creation_time").distinct().select("asset_id", label.alias("label"), detail.alias("detail"))


@reg.add("s_durations", f"""SELECT scene_id, CASE WHEN r >= 3600 THEN CAST(r // 3600 AS VARCHAR) || 'h ' || CAST(r % 3600 // 60 AS VARCHAR) || 'm' WHEN r >= 60 THEN CAST(r // 60 AS VARCHAR) || 'm ' || CAST(r % 60 AS VARCHAR) || 's' ELSE CAST(r AS VARCHAR) || 's' END AS length FROM (SELECT scene_id, CAST(round(CAST((e - s) * 40 AS DECIMAL(24,6))) AS BIGINT) AS r FROM {SCENES})""")
def s_durations(t):
    """Lengths in words (S3); forty times a scene's, so that hours are among them."""
    return scenes(t).select("scene_id", S.duration_text(S.round_dec((F.col("e") - F.col("s")) * 40, 6)).alias("length"))


@reg.add(
    "s_namespaced_references",
    """WITH g AS (SELECT asset_id, group_id, list(scene_id ORDER BY scene_id) AS ids FROM (SELECT DISTINCT asset_id, group_id, scene_id FROM scenes WHERE group_id IS NOT NULL) GROUP BY ALL)
    SELECT CASE WHEN starts_with(group_id, asset_id || ':') THEN group_id ELSE asset_id || ':' || group_id END AS group_id, list_transform(ids, lambda x: CASE WHEN starts_with(x, asset_id || ':') THEN x ELSE asset_id || ':' || x END) AS scene_ids FROM g""",
)
def s_namespaced_references(t):
    """Ids and all references to them with the asset in front, once."""
    g = t.scenes.filter("group_id IS NOT NULL").select("asset_id", "group_id", "scene_id").distinct().groupBy("asset_id", "group_id").agg(F.array_sort(F.collect_list("scene_id")).alias("scene_ids"))
    return S.with_namespace(g, "asset_id", ["group_id"], ["scene_ids"]).select("group_id", "scene_ids")


@reg.add(
    "c_map_keys",
    """WITH x AS (SELECT asset_id, requested_locale AS l, count(*) AS n FROM stt_candidates WHERE requested_locale IS NOT NULL GROUP BY ALL) SELECT asset_id, list_sort(list(l)) AS languages, CAST(sum(n) AS BIGINT) AS records FROM x GROUP BY 1""",
)
def c_map_keys(t):
    """The keys of the maps of several rows in one sorted list."""
    m = t.stt_candidates.filter("requested_locale IS NOT NULL").groupBy("asset_id", F.col("requested_locale").alias("l")).agg(F.count("*").alias("n")).select("asset_id", F.create_map("l", "n").alias("m"))
    return m.groupBy("asset_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("m"))))).alias("languages"), F.sum(F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("records"))


@reg.add(
    "c_map_merge",
    """SELECT DISTINCT asset_id, CASE WHEN title IS NULL THEN trip_id ELSE title END AS title, coalesce(trip_id, '') AS trip, 'reviewed/v1' AS schema_version FROM assets""",
)
def c_map_merge(t):
    """Maps merged, the later one's keys winning where it has a value."""
    base = F.create_map(F.lit("title"), F.col("trip_id"), F.lit("trip"), F.coalesce("trip_id", F.lit("")), F.lit("schema_version"), F.lit("raw/v1"))
    m = S.merged_maps(base, F.create_map(F.lit("title"), F.col("title"), F.lit("schema_version"), F.lit("reviewed/v1")))
    return t.assets.select("asset_id", m.alias("m")).select("asset_id", *(F.element_at("m", k).alias(k) for k in ("title", "trip", "schema_version"))).distinct()


@reg.add("m_tree_digests", """WITH f AS (SELECT DISTINCT asset_id, scene_id, sha256(scene_id || '|' || coalesce(title, '')) AS d FROM scenes) SELECT asset_id, sha256(string_agg(scene_id || ' ' || d, chr(10) ORDER BY scene_id, d)) AS digest FROM f GROUP BY 1""")
def m_tree_digests(t):
    """One digest of a folder from those of its files in the order of their paths (M10); scenes stand for files."""
    f = t.scenes.select("asset_id", "scene_id", F.sha2(F.concat_ws("|", "scene_id", F.coalesce("title", F.lit(""))), 256).alias("d")).distinct()
    return S.tree_digest(f, ["asset_id"], "scene_id", "d")


@reg.add(
    "st_stage_chain",
    """WITH s AS (SELECT user_id, k, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 4 THEN 'failed' WHEN count(*) > 12 THEN 'completed' WHEN count(*) FILTER (WHERE event_type = 'signup') > 4 THEN 'awaiting_review' ELSE 'reused' END AS st FROM (SELECT *, event_id % 5 + 1 AS k FROM events) GROUP BY ALL),
    e AS (SELECT user_id, CASE WHEN coalesce(max(CASE WHEN st = 'failed' OR starts_with(st, 'awaiting') THEN 1 ELSE 0 END) OVER w, 0) = 1 THEN 'blocked' WHEN coalesce(max(CASE WHEN st = 'completed' THEN 1 ELSE 0 END) OVER w, 0) = 1 AND st = 'reused' THEN 'completed' ELSE st END AS x FROM s WINDOW w AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, CASE WHEN bool_or(x = 'failed') THEN 'failed' WHEN bool_or(starts_with(x, 'awaiting')) THEN min(x) FILTER (WHERE starts_with(x, 'awaiting')) WHEN bool_and(x = 'reused') THEN 'reused' ELSE 'completed' END AS status FROM e GROUP BY 1""",
)
def st_stage_chain(t):
    """Status of chains of five stages, in which a failed or waiting stage blocks the later ones (ST5); a user's events of one residue stand for a stage."""
    from ..streaming import jobs as J

    n = t.events.withColumn("k", F.col("event_id") % 5 + 1).groupBy("user_id", "k").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") == "signup").alias("asks"))
    st = n.select("user_id", "k", F.when(F.col("bad") > 4, "failed").when(F.col("n") > 12, "completed").when(F.col("asks") > 4, "awaiting_review").otherwise("reused").alias("st"))
    return J.stage_status(J.stage_chain(st, "user_id", "k", "st"), "user_id", "effective")
