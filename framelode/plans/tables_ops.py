"""Projections, filters (P), aggregates (A), sorts (T) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ordered as O
from ..operators.sequence import with_row_number
from ..session import cut_lineage
from .common import PEOPLE, SCENES, SPANS, SPEECH, people, rd, scenes, spans, speech
from .registry import Registry

reg = Registry()

_NORM = "lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[^0-9A-Za-z가-힣]+', '', 'g'))"
_CHECKED = f"""(SELECT asset_id || '/' || requested_locale AS k, utterance_id AS id, s, e, {_NORM} AS norm, list_filter([CASE WHEN {_NORM} = '' THEN 'empty' END, CASE WHEN conf < 0.4 THEN 'low_logprob' END,
 CASE WHEN 1 - conf > 0.6 THEN 'likely_no_speech' END, CASE WHEN length(text) / 40.0 > 2.4 THEN 'high_repetition' END], lambda x: x IS NOT NULL) AS reasons FROM {SPEECH})"""


def _checked(t):
    """Transcript records with what speaks against each by itself."""
    norm = S.comparable(S.one_line("text"))
    why = F.array(F.when(norm == "", "empty"), F.when(F.col("conf") < 0.4, "low_logprob"), F.when(1 - F.col("conf") > 0.6, "likely_no_speech"), F.when(F.length("text") / 40.0 > 2.4, "high_repetition"))
    return speech(t).select(F.concat_ws("/", "asset_id", "requested_locale").alias("k"), F.col("utterance_id").alias("id"), "s", "e", norm.alias("norm"), F.array_compact(why).alias("reasons"))


@reg.add(
    "p_transcript_filter",
    f"""WITH RECURSIVE x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, id) AS rn FROM {_CHECKED}),
    r AS (SELECT k, rn, id, reasons AS all_reasons, CASE WHEN len(reasons) = 0 THEN norm END AS pt, CASE WHEN len(reasons) = 0 THEN e END AS pe FROM x WHERE rn = 1
     UNION ALL SELECT q.k, q.rn, q.id, q.a, CASE WHEN len(q.a) = 0 THEN q.norm ELSE q.pt END, CASE WHEN len(q.a) = 0 THEN q.e ELSE q.pe END FROM (SELECT x.*, r.pt, r.pe, CASE WHEN coalesce(x.norm = r.pt AND x.s - r.pe <= 2.0, FALSE) THEN list_append(x.reasons, 'duplicate_phrase') ELSE x.reasons END AS a FROM r JOIN x ON x.k = r.k AND x.rn = r.rn + 1) q)
    SELECT id AS utterance_id, len(all_reasons) = 0 AS accepted, array_to_string(all_reasons, ',') AS reasons FROM r""",
)
def p_transcript_filter(t):
    """Accepted records and the reasons against the others; duplicates are judged by the last accepted one."""
    x = O.accepted_speech(cut_lineage(_checked(t)), "k", "id", "s", "e", "norm", "reasons")
    return x.select(F.col("id").alias("utterance_id"), (F.size("all_reasons") == 0).alias("accepted"), F.array_join("all_reasons", ",").alias("reasons"))


@reg.add("p_inside_media", """SELECT DISTINCT v.sample_id FROM vision_samples v JOIN (SELECT DISTINCT asset_id, duration FROM assets) a USING (asset_id) WHERE v."timestamp" > 0.001 AND v."timestamp" < duration - 0.001""")
def p_inside_media(t):
    """Samples strictly inside their recording."""
    a = t.assets.select("asset_id", "duration").distinct()
    return t.vision_samples.join(a, "asset_id").filter("timestamp > 0.001 AND timestamp < duration - 0.001").select("sample_id").distinct()


@reg.add("p_select_assets", """SELECT DISTINCT asset_id FROM assets WHERE regexp_matches(asset_id, '0[0-4]$') OR regexp_matches(source_path, '(card-A|Day 1)')""")
def p_select_assets(t):
    """Assets by a pattern on id or path."""
    return t.assets.filter(F.col("asset_id").rlike("0[0-4]$") | F.col("source_path").rlike("(card-A|Day 1)")).select("asset_id").distinct()


@reg.add(
    "p_clipped_boxes",
    f"""SELECT detection_id, {rd("least(1.0, greatest(0.0, bounding_box[1]))", 6)} AS x0, {rd("least(1.0, greatest(0.0, bounding_box[2]))", 6)} AS y0, {rd("least(1.0, greatest(0.0, bounding_box[1] + bounding_box[3]))", 6)} AS x1, {rd("least(1.0, greatest(0.0, bounding_box[2] + bounding_box[4]))", 6)} AS y1,
    (bounding_box[1] < 0 OR bounding_box[2] < 0 OR bounding_box[1] + bounding_box[3] > 1 OR bounding_box[2] + bounding_box[4] > 1) AS truncated FROM {PEOPLE}""",
)
def p_clipped_boxes(t):
    """Boxes clipped to the unit square."""
    b = lambda i: F.get("bounding_box", F.lit(i))
    cut = lambda c: S.round_dec(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    return people(t).select("detection_id", cut(b(0)).alias("x0"), cut(b(1)).alias("y0"), cut(b(0) + b(2)).alias("x1"), cut(b(1) + b(3)).alias("y1"), ((b(0) < 0) | (b(1) < 0) | (b(0) + b(2) > 1) | (b(1) + b(3) > 1)).alias("truncated"))


@reg.add("p_compact_assets", f"""SELECT DISTINCT asset_id, source_name, {rd("duration", 3)} AS duration, CASE WHEN length(trim(summary)) <= 40 THEN trim(summary) ELSE rtrim(substr(trim(summary), 1, 39)) || '…' END AS summary, proxy_path IS NOT NULL AS proxy_ready FROM assets""")
def p_compact_assets(t):
    """Rows as lists show them (P10)."""
    return t.assets.select("asset_id", "source_name", S.round_dec("duration", 3).alias("duration"), S.shortened("summary", 40).alias("summary"), F.col("proxy_path").isNotNull().alias("proxy_ready")).distinct()


@reg.add("p_source_precedence", """SELECT DISTINCT scene_id, CASE WHEN dialogue_excerpt IS NOT NULL THEN 'captions' WHEN summary IS NOT NULL THEN 'script' ELSE 'none' END AS origin, CASE WHEN dialogue_excerpt IS NOT NULL THEN dialogue_excerpt ELSE summary END AS text FROM scenes""")
def p_source_precedence(t):
    """The first source whose key is there decides, even if its text is empty."""
    has = F.col("dialogue_excerpt").isNotNull()
    return t.scenes.select("scene_id", F.when(has, "captions").when(F.col("summary").isNotNull(), "script").otherwise("none").alias("origin"), F.when(has, F.col("dialogue_excerpt")).otherwise(F.col("summary")).alias("text")).distinct()


@reg.add("p_immutable_fields", """SELECT scene_id, s, e FROM (SELECT DISTINCT scene_id, source_in AS s, source_out AS e FROM scenes EXCEPT SELECT scene_id, round(source_in, 3), round(source_out, 3) FROM scenes)""")
def p_immutable_fields(t):
    """Rows whose kept fields changed between two versions, here by rounding."""
    a = t.scenes.select("scene_id", F.col("source_in").alias("s"), F.col("source_out").alias("e")).distinct()
    return a.exceptAll(t.scenes.select("scene_id", F.round("source_in", 3).alias("s"), F.round("source_out", 3).alias("e")).distinct())


@reg.add("p_flatten_windows", f"""SELECT p.utterance_id, CAST(p.span_index AS BIGINT) AS span_index, 'U' || lpad(CAST(row_number() OVER (PARTITION BY p.asset_id ORDER BY u.s, p.utterance_id, p.span_index) AS VARCHAR), 4, '0') AS number FROM {SPANS} p JOIN {SPEECH} u USING (asset_id, utterance_id)""")
def p_flatten_windows(t):
    """Spans of all records in one numbered list per asset."""
    j = spans(t).join(speech(t).select("asset_id", "utterance_id", "s"), ["asset_id", "utterance_id"])
    j = with_row_number(O.with_bucket(j, "s"), ["asset_id"], "_b", ["s", "utterance_id", "span_index"], "k")
    return j.select("utterance_id", F.col("span_index").cast("long").alias("span_index"), S.sequential_id("U", 4, "k").alias("number"))


@reg.add("p_first_reason", """SELECT DISTINCT asset_id, CASE WHEN duration IS NULL THEN 'still_recording' WHEN proxy_path IS NULL THEN 'no_proxy' WHEN creation_time IS NULL THEN 'no_time' WHEN scene_count = 0 THEN 'no_scenes' END AS reason FROM assets""")
def p_first_reason(t):
    """The first rule of a chain that excludes an asset, null if none does."""
    return t.assets.select("asset_id", F.when(F.col("duration").isNull(), "still_recording").when(F.col("proxy_path").isNull(), "no_proxy").when(F.col("creation_time").isNull(), "no_time").when(F.col("scene_count") == 0, "no_scenes").alias("reason")).distinct()


@reg.add("a_category_counts", """SELECT l.lang, count(d.doc_id) AS n FROM (VALUES ('en'), ('ko'), ('ja'), ('it')) l(lang) LEFT JOIN documents d ON d.lang = l.lang GROUP BY 1""")
def a_category_counts(t):
    """Counts by category, absent ones with zero (A1)."""
    known = t.spark.createDataFrame([(x,) for x in ("en", "ko", "ja", "it")], "lang string")
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(n, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"))


@reg.add("a_conditional", f"""SELECT asset_id, count(*) AS scenes, count(*) FILTER (WHERE highlighted) AS highlights, {rd("CAST(sum(CASE WHEN confidence >= 0.8 THEN CAST(e - s AS DECIMAL(24,6)) ELSE 0 END) AS DOUBLE)", 4)} AS sure_seconds FROM {SCENES} GROUP BY 1""")
def a_conditional(t):
    """Conditional counts and sums (A2)."""
    d = (F.col("e") - F.col("s")).cast("decimal(24,6)")
    return scenes(t).groupBy("asset_id").agg(F.count("*").alias("scenes"), F.count_if("highlighted").alias("highlights"), S.round_dec(F.sum(F.when(F.col("confidence") >= 0.8, d).otherwise(F.lit(0).cast("decimal(24,6)"))).cast("double"), 4).alias("sure_seconds"))


@reg.add("a_weighted_confidence", f"""SELECT asset_id, {rd("sum(conf * greatest(0.001, e - s)) / sum(CASE WHEN conf IS NOT NULL THEN greatest(0.001, e - s) END)", 4)} AS weighted, {rd("avg(conf)", 4)} AS plain FROM {SPEECH} GROUP BY 1""")
def a_weighted_confidence(t):
    """Confidence weighted by duration, and the mean of those there (A4, A5)."""
    d = F.greatest(F.lit(0.001), F.col("e") - F.col("s"))
    return speech(t).groupBy("asset_id").agg(S.round_dec(F.sum(F.col("conf") * d) / F.sum(F.when(F.col("conf").isNotNull(), d)), 4).alias("weighted"), S.round_dec(F.avg("conf"), 4).alias("plain"))


@reg.add("a_noisy_or", f"""SELECT asset_id, {rd("least(0.99, 1 - exp(sum(ln(1 - least(0.95, confidence * 0.3)))))", 4)} AS fused, arg_max(scene_id, (confidence, scene_id)) AS best FROM {SCENES} WHERE confidence IS NOT NULL GROUP BY 1""")
def a_noisy_or(t):
    """Confidences fused as independent hints, and the best scene."""
    x = scenes(t).filter("confidence IS NOT NULL")
    return x.groupBy("asset_id").agg(S.round_dec(F.least(F.lit(0.99), 1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.95), F.col("confidence") * 0.3))))), 4).alias("fused"), F.max_by("scene_id", F.struct("confidence", "scene_id")).alias("best"))


@reg.add("a_flag_union", """SELECT asset_id, list_sort(list(DISTINCT tag)) AS flags FROM (SELECT asset_id, unnest(tags) AS tag FROM scenes) GROUP BY 1""")
def a_flag_union(t):
    """The union of sets, sorted (A10)."""
    return t.scenes.select("asset_id", F.explode("tags").alias("tag")).groupBy("asset_id").agg(F.array_sort(F.collect_set("tag")).alias("flags"))


@reg.add("a_text_concat", f"""SELECT asset_id, requested_locale, CAST(floor(s / 60) AS BIGINT) AS minute, substr(string_agg(text, ' ' ORDER BY s, e, utterance_id), 1, 500) AS text, arg_min(utterance_id, (s, e, utterance_id)) AS first_id FROM {SPEECH} GROUP BY ALL""")
def a_text_concat(t):
    """Texts of a minute in order, cut at 500 characters."""
    g = speech(t).groupBy("asset_id", "requested_locale", F.floor(F.col("s") / 60).cast("long").alias("minute")).agg(F.sort_array(F.collect_list(F.struct("s", "e", "utterance_id", "text"))).alias("xs"))
    return g.select("asset_id", "requested_locale", "minute", F.substring(F.array_join(F.transform("xs", lambda x: x["text"]), " "), 1, 500).alias("text"), F.get("xs", F.lit(0))["utterance_id"].alias("first_id"))


@reg.add("a_distinct_records", f"""SELECT DISTINCT asset_id, s, e, text FROM {SPEECH}""")
def a_distinct_records(t):
    """Distinct by several columns."""
    return speech(t).select("asset_id", "s", "e", "text").dropDuplicates()


_DAYS = """(SELECT *, CASE WHEN length(creation_time) >= 10 THEN substr(creation_time, 1, 10) ELSE 'unknown' END AS day FROM (SELECT DISTINCT asset_id, creation_time, duration, title, tags, scene_count, source_name FROM assets))"""


def _days(t):
    return t.assets.select("asset_id", "creation_time", "duration", "title", "tags", "scene_count", "source_name").distinct().withColumn("day", S.capture_day("creation_time"))


@reg.add(
    "a_day_rollup",
    f"""WITH c AS (SELECT day, tag, count(*) AS n FROM (SELECT day, unnest(tags) AS tag FROM {_DAYS}) GROUP BY ALL), k AS (SELECT day, tag, row_number() OVER (PARTITION BY day ORDER BY n DESC, tag) AS r FROM c),
    tt AS (SELECT day, list(tag ORDER BY r) AS top FROM k WHERE r <= 6 GROUP BY 1), ti AS (SELECT day, list(title ORDER BY rr) AS titles FROM (SELECT day, title, row_number() OVER (PARTITION BY day ORDER BY coalesce(creation_time, '9999'), source_name, asset_id) AS rr FROM {_DAYS}) WHERE rr <= 5 GROUP BY 1)
    SELECT d.day, count(*) AS assets, CAST(sum(scene_count) AS BIGINT) AS scenes, {rd("coalesce(CAST(sum(CAST(duration AS DECIMAL(24,6))) AS DOUBLE), 0.0)", 3)} AS duration, array_to_string(any_value(coalesce(top, [])), '|') AS top_tags, array_to_string(any_value(titles), '|') AS titles FROM {_DAYS} d LEFT JOIN tt USING (day) LEFT JOIN ti USING (day) GROUP BY 1""",
)
def a_day_rollup(t):
    """Per day: counts, seconds, first five titles, six most frequent tags."""
    d = _days(t)
    sums = d.groupBy("day").agg(F.count("*").alias("assets"), F.sum("scene_count").cast("long").alias("scenes"), S.round_dec(F.coalesce(F.sum(F.col("duration").cast("decimal(24,6)")).cast("double"), F.lit(0.0)), 3).alias("duration"))
    c = d.select("day", F.explode("tags").alias("tag")).groupBy("day", "tag").agg(F.count("*").alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "tag"))).filter("r <= 6")
    top = c.groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), "|").alias("top_tags"))
    w = Window.partitionBy("day").orderBy(F.coalesce("creation_time", F.lit("9999")), "source_name", "asset_id")
    # A day's assets are dealt to 64 parts first, so that a full day is no single task.
    part = Window.partitionBy("day", F.pmod(F.xxhash64("asset_id"), F.lit(64))).orderBy(F.coalesce("creation_time", F.lit("9999")), "source_name", "asset_id")
    few = d.withColumn("r", F.row_number().over(part)).filter("r <= 5")
    first = few.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), "|").alias("titles"))
    return sums.join(top, "day", "left").join(first, "day", "left").select("day", "assets", "scenes", "duration", F.coalesce("top_tags", F.lit("")).alias("top_tags"), "titles")


@reg.add(
    "a_project_summary",
    f"""WITH k AS (SELECT string_agg(tag, '|' ORDER BY n DESC, tag) AS top FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {_DAYS}) GROUP BY 1 ORDER BY n DESC, tag LIMIT 10))
    SELECT count(*) AS assets, CAST(sum(scene_count) AS BIGINT) AS scenes, min(CASE WHEN day <> 'unknown' THEN day END) AS first_day, max(CASE WHEN day <> 'unknown' THEN day END) AS last_day, count(DISTINCT day) AS days, (SELECT top FROM k) AS top_tags FROM {_DAYS}""",
)
def a_project_summary(t):
    """Totals of the whole library with its ten most frequent tags."""
    d = _days(t)
    top = d.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)
    top = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]), "|").alias("top_tags"))
    known = F.when(F.col("day") != "unknown", F.col("day"))
    tot = d.agg(F.count("*").alias("assets"), F.sum("scene_count").cast("long").alias("scenes"), F.min(known).alias("first_day"), F.max(known).alias("last_day"), F.countDistinct("day").alias("days"))
    return tot.join(F.broadcast(top))


@reg.add("a_latest_per_key", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def a_latest_per_key(t):
    """The last event of each key wins (A16, ST1)."""
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("user_id", "event_type", "x.event_id", "x.value")


@reg.add("a_edit_duration", f"""SELECT asset_id, {rd("CAST(sum(CAST((e - s) / (CASE WHEN highlighted THEN 0.5 ELSE 2.0 END) AS DECIMAL(24,9))) AS DOUBLE)", 4)} AS seconds FROM {SCENES} GROUP BY 1""")
def a_edit_duration(t):
    """Length of a timeline at the speed of its clips."""
    x = ((F.col("e") - F.col("s")) / F.when(F.col("highlighted"), 0.5).otherwise(2.0)).cast("decimal(24,9)")
    return scenes(t).groupBy("asset_id").agg(S.round_dec(F.sum(x).cast("double"), 4).alias("seconds"))


@reg.add("a_ratio", f"""SELECT l_returnflag, {rd("CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / nullif(CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE), 0)", 6)} AS ratio FROM lineitem GROUP BY 1""")
def a_ratio(t):
    """A ratio that is null over nothing."""
    s = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(S.round_dec(s("l_discount") / F.nullif(s("l_tax"), F.lit(0.0)), 6).alias("ratio"))


@reg.add("a_repetition_audit", """SELECT asset_id, summary, count(*) AS n FROM (SELECT DISTINCT asset_id, scene_id, summary FROM scenes WHERE trim(coalesce(summary, '')) <> '') GROUP BY ALL HAVING count(*) > 1""")
def a_repetition_audit(t):
    """Summaries that an asset's scenes share (A21, first rule)."""
    return t.scenes.filter("trim(coalesce(summary, '')) <> ''").select("asset_id", "scene_id", "summary").distinct().groupBy("asset_id", "summary").agg(F.count("*").alias("n")).filter("n > 1")


@reg.add(
    "a_shared_claims",
    """WITH x AS (SELECT DISTINCT asset_id, scene_id, tags FROM scenes), b AS (SELECT asset_id, count(DISTINCT scene_id) AS beats FROM x GROUP BY 1),
    c AS (SELECT asset_id, claim, count(DISTINCT scene_id) AS n FROM (SELECT asset_id, scene_id, trim(unnest(tags)) AS claim FROM x) WHERE claim <> '' GROUP BY ALL) SELECT asset_id, claim, n, beats FROM c JOIN b USING (asset_id) WHERE n >= 3 AND n * 2 > beats""",
)
def a_shared_claims(t):
    """Claims that at least three and more than half of an asset's scenes share (A21, second rule); a scene's claims are its tags, each counted once."""
    x = t.scenes.select("asset_id", "scene_id", "tags").distinct()
    beats = x.groupBy("asset_id").agg(F.countDistinct("scene_id").alias("beats"))
    claims = x.select("asset_id", "scene_id", F.explode("tags").alias("claim")).select("asset_id", "scene_id", F.trim("claim").alias("claim")).filter("claim <> ''").distinct()
    return claims.groupBy("asset_id", "claim").agg(F.count("*").alias("n")).join(beats, "asset_id").filter((F.col("n") >= 3) & (F.col("n") * 2 > F.col("beats"))).select("asset_id", "claim", "n", "beats")


@reg.add("a_unassessed", """SELECT asset_id, count(*) FILTER (WHERE len(tags) = 0) AS no_tags, count(*) FILTER (WHERE dialogue_excerpt IS NULL) AS no_dialogue FROM (SELECT DISTINCT asset_id, scene_id, tags, dialogue_excerpt FROM scenes) GROUP BY 1""")
def a_unassessed(t):
    """Per field, how many scenes leave it open."""
    return t.scenes.select("asset_id", "scene_id", "tags", "dialogue_excerpt").distinct().groupBy("asset_id").agg(F.count_if(F.size("tags") == 0).alias("no_tags"), F.count_if(F.col("dialogue_excerpt").isNull()).alias("no_dialogue"))


@reg.add(
    "a_language_resolution",
    f"""WITH m AS (SELECT asset_id, requested_locale AS l, count(*) FILTER (WHERE conf >= 0.6) AS n, CAST(coalesce(sum(length(text)) FILTER (WHERE conf >= 0.6), 0) AS BIGINT) AS c, {rd("avg(conf) FILTER (WHERE conf >= 0.6)", 4)} AS mean FROM {SPEECH} GROUP BY ALL),
    g AS (SELECT asset_id, list(l ORDER BY l) FILTER (WHERE n > 0) AS usable, arg_max(l, (c, l)) FILTER (WHERE n > 0) AS longest, max(mean) AS best FROM m GROUP BY 1)
    SELECT asset_id, CASE WHEN usable IS NULL THEN 'unknown' WHEN len(usable) = 1 THEN usable[1] WHEN best >= 0.95 THEN longest ELSE 'mixed_or_uncertain' END AS spoken, longest AS provisional, CASE WHEN usable IS NULL THEN 'no_accepted_candidate' WHEN len(usable) = 1 THEN 'only_usable_candidate' WHEN best >= 0.95 THEN 'strong_language_detection' ELSE 'multiple_usable_language_candidates' END AS reason FROM g""",
)
def a_language_resolution(t):
    """Which locale an asset is spoken in, as far as its usable candidates tell."""
    ok = F.col("conf") >= 0.6
    m = speech(t).groupBy("asset_id", F.col("requested_locale").alias("l")).agg(F.count_if(ok).alias("n"), F.coalesce(F.sum(F.when(ok, F.length("text"))), F.lit(0)).alias("c"), S.round_dec(F.avg(F.when(ok, F.col("conf"))), 4).alias("mean"))
    has = F.col("n") > 0
    g = m.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.when(has, F.col("l")))).alias("u"), F.max_by(F.when(has, F.col("l")), F.when(has, F.struct("c", "l"))).alias("longest"), F.max("mean").alias("best"))
    n = F.size("u")
    return g.select("asset_id", F.when(n == 0, "unknown").when(n == 1, F.get("u", F.lit(0))).when(F.col("best") >= 0.95, F.col("longest")).otherwise("mixed_or_uncertain").alias("spoken"), F.col("longest").alias("provisional"), F.when(n == 0, "no_accepted_candidate").when(n == 1, "only_usable_candidate").when(F.col("best") >= 0.95, "strong_language_detection").otherwise("multiple_usable_language_candidates").alias("reason"))


_RANKED = r"""WITH q AS (SELECT list_distinct(list_filter(regexp_extract_all(lower('Muddy stone bridge'), '([\p{L}\p{N}_]+)', 1), lambda w: length(w) > 1)) AS toks), s AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(search_text), '([\p{L}\p{N}_]+)', 1), lambda w: length(w) > 1)) AS st FROM """


@reg.add("t_list_assets", f"""SELECT asset_id, source_name FROM {_DAYS} WHERE starts_with(day, '2025-0') ORDER BY coalesce(creation_time, '9999'), source_name, asset_id LIMIT 100""")
def t_list_assets(t):
    """Assets of a span of days in capture order, at most a hundred."""
    return _days(t).filter(F.col("day").startswith("2025-0")).orderBy(F.coalesce("creation_time", F.lit("9999")), "source_name", "asset_id").limit(100).select("asset_id", "source_name")


#: Lengths of the limited lists of a project: days, index of assets, assets of a span of days, tags.
LIST_LIMITS = {"day_rollups": 31, "asset_index": 100, "list_assets": 100, "top_tags": 10}


@reg.add(
    "t_truncated_lists",
    f"""WITH n AS (SELECT 'day_rollups' AS list, count(DISTINCT day) AS total, {LIST_LIMITS["day_rollups"]} AS lim FROM {_DAYS} UNION ALL SELECT 'asset_index', count(*), {LIST_LIMITS["asset_index"]} FROM {_DAYS}
    UNION ALL SELECT 'list_assets', count(*), {LIST_LIMITS["list_assets"]} FROM {_DAYS} WHERE starts_with(day, '2025-0') UNION ALL SELECT 'top_tags', count(DISTINCT tag), {LIST_LIMITS["top_tags"]} FROM (SELECT unnest(tags) AS tag FROM {_DAYS}))
    SELECT list, total, least(total, lim) AS shown, total > lim AS truncated FROM n""",
)
def t_truncated_lists(t):
    """For each limited list of a project its full length, the rows shown and whether it is cut (T4)."""
    d = _days(t)
    n = d.agg(F.countDistinct("day").alias("day_rollups"), F.count("*").alias("asset_index"), F.count_if(F.col("day").startswith("2025-0")).alias("list_assets"))
    n = n.unpivot([], list(n.columns), "list", "total").unionByName(d.select(F.explode("tags").alias("tag")).agg(F.countDistinct("tag").alias("total")).select(F.lit("top_tags").alias("list"), "total"))
    lim = F.element_at(F.create_map(*[F.lit(x) for kv in LIST_LIMITS.items() for x in kv]), F.col("list"))
    return n.select("list", "total", F.least("total", lim.cast("long")).alias("shown"), (F.col("total") > lim).alias("truncated"))


@reg.add("t_pages", f"""SELECT scene_id, (k - 1) // 12 + 1 AS page, chr(CAST(65 + ((k - 1) % 12) // 3 AS INT)) || CAST((k - 1) % 3 + 1 AS VARCHAR) AS cell FROM (SELECT scene_id, row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS k FROM {SCENES})""")
def t_pages(t):
    """Pages of twelve with cells A1 to D3."""
    x = with_row_number(O.with_bucket(scenes(t), "s"), ["asset_id"], "_b", ["s", "scene_id"], "n").withColumn("k", F.col("n") - 1)
    return x.select("scene_id", (F.floor(F.col("k") / 12) + 1).cast("long").alias("page"), F.concat(F.char(65 + F.floor((F.col("k") % 12) / 3)), (F.col("k") % 3 + 1).cast("string")).alias("cell"))


@reg.add("u_difference", """SELECT asset_id FROM (SELECT asset_id FROM assets EXCEPT SELECT asset_id FROM scenes)""")
def u_difference(t):
    """Ids of one table that the other lacks."""
    return t.assets.select("asset_id").distinct().join(t.scenes, "asset_id", "left_anti")


@reg.add("u_intersection", """SELECT asset_id FROM ocr_lines INTERSECT SELECT asset_id FROM person_detections INTERSECT SELECT asset_id FROM stt_candidates""")
def u_intersection(t):
    """Ids of all three tables."""
    return t.ocr_lines.select("asset_id").intersect(t.person_detections.select("asset_id")).intersect(t.stt_candidates.select("asset_id"))


@reg.add("u_disjoint", """SELECT DISTINCT scene_id, NOT list_has_any(s.tags, a.tags) AS disjoint FROM scenes s JOIN (SELECT DISTINCT asset_id, tags FROM assets) a USING (asset_id)""")
def u_disjoint(t):
    """Whether a scene's tags and its asset's have nothing in common (U4)."""
    a = t.assets.select("asset_id", F.col("tags").alias("at")).distinct()
    return t.scenes.join(a, "asset_id").select("scene_id", (~F.arrays_overlap("tags", "at")).alias("disjoint")).distinct()


@reg.add("u_packet_slice", f"""SELECT asset_id, count(*) AS scenes, count(*) FILTER (WHERE highlighted) AS highlights FROM {SCENES} WHERE asset_id IN (SELECT asset_id FROM person_detections) GROUP BY 1""")
def u_packet_slice(t):
    """A part of the rows with summaries counted anew."""
    return scenes(t).join(t.person_detections, "asset_id", "left_semi").groupBy("asset_id").agg(F.count("*").alias("scenes"), F.count_if("highlighted").alias("highlights"))


@reg.add("u_append_unseen", """SELECT asset_id, t FROM (SELECT DISTINCT asset_id, "timestamp" AS t FROM vision_samples WHERE "timestamp" IS NOT NULL UNION SELECT asset_id, "timestamp" FROM person_detections WHERE "timestamp" IS NOT NULL)""")
def u_append_unseen(t):
    """Rows of a second table added where the first has none."""
    a = t.vision_samples.select("asset_id", F.col("timestamp").alias("t")).filter("t IS NOT NULL").distinct()
    b = t.person_detections.select("asset_id", F.col("timestamp").alias("t")).filter("t IS NOT NULL").distinct()
    return a.unionByName(b.join(a, ["asset_id", "t"], "left_anti"))


@reg.add(
    "w_line_merge",
    f"""WITH RECURSIVE x AS MATERIALIZED (SELECT asset_id || '/' || requested_locale AS k, utterance_id AS id, s, e, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS tx, row_number() OVER (PARTITION BY asset_id, requested_locale ORDER BY s, utterance_id) AS rn FROM {SPEECH}),
    r AS (SELECT k, rn, id, id AS line, s AS first, e, tx, CAST(length(tx) AS BIGINT) AS chars, CAST(1 AS BIGINT) AS n FROM x WHERE rn = 1
    UNION ALL SELECT q.k, q.rn, q.id, CASE WHEN j THEN q.line ELSE q.id END, CASE WHEN j THEN q.first ELSE q.s END, q.e, q.tx, CAST(length(q.tx) + CASE WHEN j THEN q.chars ELSE 0 END AS BIGINT), CASE WHEN j THEN q.n + 1 ELSE 1 END
    FROM (SELECT x.*, r.line, r.first, r.chars, r.n, NOT (x.s - r.e < -0.05 OR x.s - r.e > 2.2 OR x.e - r.first > 20.0 OR r.chars + length(x.tx) + r.n > 160 OR (regexp_matches(r.tx, '[.?!。？！]$') AND x.s - r.e > 0.55)) AS j FROM r JOIN x ON x.k = r.k AND x.rn = r.rn + 1) q)
    SELECT id AS utterance_id, line AS line_id FROM r""",
)
def w_line_merge(t):
    """Transcript records joined to lines."""
    x = speech(t).select(F.concat_ws("/", "asset_id", "requested_locale").alias("k"), F.col("utterance_id").alias("id"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("requested_locale").alias("language"), "text")
    return O.merged_lines(cut_lineage(x), "k", "id").select(F.col("id").alias("utterance_id"), F.col("line").alias("line_id"))
