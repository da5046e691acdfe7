"""Scalar functions over the tables (S, M, D, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.similarity import path_key, sequence_ratio
from .common import OCR, SCENES, SPEECH, ocr, rd, scenes, speech
from .registry import Registry

reg = Registry()

_MS = "CAST(round(CAST({x} AS DECIMAL(24,12)) * 1000, 0) AS BIGINT)"


def _tc(x: str) -> str:
    ms = f"greatest(0, {_MS.format(x=x)})"
    return f"CASE WHEN {ms} >= 3600000 THEN printf('%02d:%02d:%02d.%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000) ELSE printf('%02d:%02d.%03d', ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000) END"


@reg.add(
    "s_timecodes",
    f"""SELECT scene_id, {_tc("s")} AS start_timecode, {_tc("e")} AS end_timecode,
    printf('%02d:%02d:%02d,%03d', {_MS.format(x="s")} // 3600000, ({_MS.format(x="s")} // 60000) % 60, ({_MS.format(x="s")} // 1000) % 60, {_MS.format(x="s")} % 1000) AS srt,
    CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(s) AS BIGINT) // 3600, (CAST(floor(s) AS BIGINT) // 60) % 60, CAST(floor(s) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) END AS short
    FROM {SCENES}""",
)
def s_timecodes(t):
    return scenes(t).select("scene_id", S.timecode("s").alias("start_timecode"), S.timecode("e").alias("end_timecode"), S.srt_time("s").alias("srt"), S.short_time("s").alias("short"))


@reg.add(
    "s_clean_text",
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one_line, trim(regexp_replace(regexp_replace(text, '\s+([,.!?])', '\1', 'g'), '\s+', ' ', 'g')) AS compact,
    lower(regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g')) AS comparable,
    CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 60 THEN trim(regexp_replace(text, '\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 59)) || '…' END AS shortened FROM documents""",
)
def s_clean_text(t):
    return t.documents.select("doc_id", S.one_line("text").alias("one_line"), S.compact_text("text").alias("compact"), S.comparable("text").alias("comparable"), S.shortened("text", 60).alias("shortened"))


@reg.add(
    "s_search_tokens",
    r"""SELECT doc_id, w AS token FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1))) AS w FROM documents) WHERE length(w) > 1""",
)
def s_search_tokens(t):
    return t.documents.select("doc_id", F.explode(S.tokens("text")).alias("token"))


@reg.add(
    "s_ocr_tokens",
    rf"""SELECT asset_id, ts, w AS token FROM (SELECT DISTINCT asset_id, ts, unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1)) AS w FROM {OCR} WHERE conf >= 0.35) WHERE length(w) >= 2""",
)
def s_ocr_tokens(t):
    return ocr(t).filter("conf >= 0.35").select("asset_id", "ts", F.explode(S.tokens("text")).alias("token")).distinct()


@reg.add(
    "s_slugs",
    r"""SELECT DISTINCT asset_id, regexp_replace(regexp_replace(source_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    coalesce(regexp_matches(source_name, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$'), FALSE) AS safe, list_transform(tags, lambda x: CASE WHEN starts_with(x, asset_id || ':') THEN x ELSE asset_id || ':' || x END) AS scoped FROM assets""",
)
def s_slugs(t):
    return t.assets.select("asset_id", S.slug("source_name").alias("slug"), S.safe_id("source_name").alias("safe"), S.namespaced("tags", "asset_id").alias("scoped")).distinct()


@reg.add("s_sentence_marks", rf"""SELECT utterance_id, regexp_matches(text, '[.?!。？！]$') AS closed, (contains(text, '…') OR contains(text, '...')) AS trailing FROM {SPEECH}""")
def s_sentence_marks(t):
    return speech(t).select("utterance_id", S.ends_sentence("text").alias("closed"), S.trails_off("text").alias("trailing"))


@reg.add("s_substring_search", """SELECT DISTINCT scene_id, contains(lower(search_text), lower('Bridge')) AS hit FROM scenes""")
def s_substring_search(t):
    return t.scenes.select("scene_id", F.lower("search_text").contains(F.lower(F.lit("Bridge"))).alias("hit")).distinct()


@reg.add(
    "s_text_chunks",
    """SELECT doc_id, CAST(i AS BIGINT) AS chunk, substr(text, CAST(i * 200 + 1 AS BIGINT), 200) AS part FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(length(text) / 200.0) AS BIGINT) - 1)) AS i FROM documents WHERE length(text) > 0)""",
)
def s_text_chunks(t):
    return t.documents.select("doc_id", F.posexplode(S.chunks("text", 200)).alias("chunk", "part")).withColumn("chunk", F.col("chunk").cast("long"))


@reg.add("s_path_keys")
def s_path_keys(t):
    return t.assets.select("asset_id", path_key("source_path").alias("path_key")).distinct()


@reg.add("s_sequence_ratio")
def s_sequence_ratio(t):
    """Similarity of each scene's summary and dialogue."""
    return scenes(t).join(t.scenes.select("scene_id", "dialogue_excerpt").distinct(), "scene_id").select("scene_id", sequence_ratio("summary", "dialogue_excerpt").alias("ratio"))


@reg.add(
    "m_clamped_overlap",
    f"""SELECT scene_id, {rd("greatest(0.0, least(1.0, confidence * 1.3 - 0.2))", 4)} AS clamped, {rd("greatest(0.0, least(e, 30.0) - greatest(s, 10.0))", 6)} AS shared FROM {SCENES} WHERE confidence IS NOT NULL""",
)
def m_clamped_overlap(t):
    return scenes(t).filter("confidence IS NOT NULL").select("scene_id", S.unit(F.col("confidence") * 1.3 - 0.2).alias("clamped"), S.round_dec(S.overlap("s", "e", F.lit(10.0), F.lit(30.0)), 6).alias("shared"))


@reg.add(
    "m_jaccard_tags",
    """WITH s AS (SELECT DISTINCT scene_id, asset_id, tags FROM scenes), a AS (SELECT DISTINCT asset_id, tags AS asset_tags FROM assets)
    SELECT scene_id, CASE WHEN len(list_distinct(list_concat(tags, asset_tags))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(tags), list_distinct(asset_tags))) / len(list_distinct(list_concat(tags, asset_tags))) END AS similarity FROM s JOIN a USING (asset_id)""",
)
def m_jaccard_tags(t):
    s = t.scenes.select("scene_id", "asset_id", "tags").distinct()
    a = t.assets.select("asset_id", F.col("tags").alias("asset_tags")).distinct()
    return s.join(a, "asset_id").select("scene_id", S.jaccard("tags", "asset_tags").alias("similarity"))


@reg.add(
    "m_hash_distance",
    """WITH h AS (SELECT DISTINCT asset_id, quick_fingerprint AS h FROM assets), x AS (SELECT asset_id, h, lag(h) OVER (ORDER BY asset_id) AS p FROM h)
    SELECT asset_id, (bit_count(xor(('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(p, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(p, 9, 8))::BIGINT))) / 64.0 AS distance FROM x WHERE p IS NOT NULL""",
)
def m_hash_distance(t):
    """Distance of the fingerprints of assets next to each other in the order of their ids."""
    a = t.assets.select("asset_id", F.col("quick_fingerprint").alias("h")).distinct().withColumns({"one": F.lit(1), "_b": F.substring("asset_id", 1, 6)})
    from ..operators.sequence import with_previous

    p = with_previous(a, ["one"], "_b", ["asset_id"], ["h"], "_p").filter("_p IS NOT NULL")
    return p.select("asset_id", S.hamming64("h", "_p.h").alias("distance"))


@reg.add(
    "m_frame_quality",
    f"""WITH f AS (SELECT DISTINCT asset_id, sample_id, least(1.0, greatest(0.0, (coalesce(aesthetics_score, 0) + 1) / 2)) AS b, coalesce(feature_distance, 0) AS c FROM vision_samples)
    SELECT sample_id, {rd("greatest(0.0, least(1.0, 0.55 + c / 10 * 1.8 + c * 0.5 - (greatest(0.0, 0.10 - b) * 3 + greatest(0.0, b - 0.92) * 3)))", 4)} AS quality,
    list_filter([CASE WHEN b < 0.10 THEN 'dark' WHEN b > 0.92 THEN 'overexposed' END, CASE WHEN c / 10 < 0.035 THEN 'low_detail' END], lambda x: x IS NOT NULL) AS flags FROM f""",
)
def m_frame_quality(t):
    f = t.vision_samples.select("asset_id", "sample_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce("aesthetics_score", F.lit(0.0)) + 1) / 2)).alias("b"), F.coalesce("feature_distance", F.lit(0.0)).alias("c")).distinct()
    return f.select("sample_id", S.frame_quality("b", "c", F.col("c") / 10).alias("quality"), S.exposure_flags("b", F.col("c") / 10).alias("flags"))


@reg.add("m_rationals", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(30000 + o_custkey AS DOUBLE) / (o_orderkey % 7) END AS rate FROM orders""")
def m_rationals(t):
    text = F.concat((30000 + F.col("o_custkey")).cast("string"), F.lit("/"), (F.col("o_orderkey") % 7).cast("string"))
    return t.orders.select("o_orderkey", S.rational(text).alias("rate"))


@reg.add(
    "m_tempo_steps",
    """WITH s AS (SELECT p_partkey, p_size / 4.0 AS v FROM part), n AS (SELECT p_partkey, v, CASE WHEN v > 2 THEN 2.0 WHEN v < 0.5 THEN 0.5 ELSE 1.0 END AS b, CASE WHEN v > 2 THEN CAST(ceil(log2(v)) AS INT) - 1 WHEN v < 0.5 THEN CAST(ceil(-log2(v)) AS INT) - 1 ELSE 0 END AS k FROM s)
    SELECT p_partkey, list_concat(list_transform(generate_series(1, k), lambda i: CAST(b AS DOUBLE)), [CAST(v / pow(b, k) AS DOUBLE)]) AS steps FROM n""",
)
def m_tempo_steps(t):
    return t.part.select("p_partkey", S.tempo_steps(F.col("p_size") / 4.0).alias("steps"))


@reg.add(
    "m_digests",
    """SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) AS digest, substr(sha256(doc_id::VARCHAR || '|' || coalesce(lang, '') || '|' || coalesce(source, '')), 1, 16) AS stable_id FROM documents""",
)
def m_digests(t):
    return t.documents.select("doc_id", S.digest("source", "lang", "doc_id").alias("digest"), S.stable_id("doc_id", "lang", "source").alias("stable_id"))


@reg.add(
    "m_sequence_hash",
    """SELECT asset_id, sha256(string_agg(scene_id || ':' || title, ';' ORDER BY scene_id)) AS tree FROM (SELECT DISTINCT asset_id, scene_id, coalesce(title, '') AS title FROM scenes) GROUP BY asset_id""",
)
def m_sequence_hash(t):
    """Digest of an ordered listing, as of a folder's files."""
    rows = t.scenes.select("asset_id", "scene_id", F.coalesce("title", F.lit("")).alias("title")).distinct()
    line = F.transform(F.sort_array(F.collect_list(F.struct("scene_id", "title"))), lambda x: F.concat_ws(":", x["scene_id"], x["title"]))
    return rows.groupBy("asset_id").agg(F.sha2(F.array_join(line, ";"), 256).alias("tree"))


@reg.add("d_capture_days", r"""SELECT DISTINCT asset_id, CASE WHEN length(creation_time) >= 10 THEN substr(creation_time, 1, 10) ELSE 'unknown' END AS day, coalesce(regexp_matches(substr(creation_time, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(substr(creation_time, 1, 10) AS DATE) IS NOT NULL, FALSE) AS valid FROM assets""")
def d_capture_days(t):
    return t.assets.select("asset_id", S.capture_day("creation_time").alias("day"), F.coalesce(S.valid_day(F.substring("creation_time", 1, 10)), F.lit(False)).alias("valid")).distinct()


@reg.add("c_json_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def c_json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@reg.add(
    "c_array_tools",
    """SELECT DISTINCT asset_id, list_sort(tags) AS ordered, tags[1:2] AS first_two, CAST(len(tags) AS BIGINT) AS n, len(list_distinct(tags)) = len(tags) AS all_distinct, list_contains(tags, 'drone') AS has_drone FROM assets""",
)
def c_array_tools(t):
    return t.assets.select("asset_id", F.array_sort("tags").alias("ordered"), F.slice("tags", 1, 2).alias("first_two"), F.size("tags").cast("long").alias("n"), (F.size(F.array_distinct("tags")) == F.size("tags")).alias("all_distinct"), F.array_contains("tags", "drone").alias("has_drone")).distinct()


@reg.add("c_union_keys", """SELECT trip_id, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT trip_id, unnest(tags) AS tag FROM assets) GROUP BY trip_id""")
def c_union_keys(t):
    return t.assets.select("trip_id", F.explode("tags").alias("tag")).groupBy("trip_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


@reg.add("c_nested_projection", """SELECT DISTINCT asset_id, list_transform(range(0, len(tags)), lambda i: i::VARCHAR || ':' || tags[i + 1]) AS entries FROM assets""")
def c_nested_projection(t):
    return t.assets.select("asset_id", F.transform("tags", lambda x, i: F.concat_ws(":", i.cast("string"), x)).alias("entries")).distinct()
