"""Sources, sinks, edits, job state, and what SQL adds beyond (SRC, SNK, ST, EXT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as Q
from ..operators import edits as E
from ..operators.ordered import with_bucket
from ..operators.sequence import with_row_number
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs as J
from ..session import cut_lineage
from .common import SCENES, SPEECH, VISION, rd, scenes, speech, vision
from .registry import Registry

reg = Registry()


@reg.add("src_json_lines", """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 10 = 0 THEN 'line ' || event_id || ' isn''t an object' END AS warning FROM events""")
def src_json_lines(t):
    """Lines of a log of which every tenth is broken (SRC3)."""
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), F.col("props"))).otherwise(F.col("props"))
    return R.parse_lines(t.events.select("event_id", text.alias("text")), "event_id", "text", "k long").select("event_id", F.col("row.k").alias("k"), "warning")


@reg.add("src_unique_names", """SELECT lower(source_name) AS name, min(source_path) AS path FROM (SELECT DISTINCT source_name, source_path FROM assets) GROUP BY 1 HAVING count(*) = 1""")
def src_unique_names(t):
    return R.unique_names(t.assets.select("source_name", "source_path").distinct(), "source_name", "source_path")


@reg.add("src_tool_metadata", """SELECT user_id, CAST(event_id AS DOUBLE) AS "timestamp", CAST(value AS DOUBLE) AS value FROM events WHERE event_id % 3 <> 0""")
def src_tool_metadata(t):
    """Times and values of a tool's output, some values without a time of their own (SRC7)."""
    e = t.events.select("user_id", "event_id", "value")
    times = e.filter("event_id % 3 <> 0").select("user_id", (F.col("event_id") * 2).alias("n"), F.concat(F.lit("frame pts_time: "), F.col("event_id").cast("string")).alias("line"))
    values = e.select("user_id", (F.col("event_id") * 2 + 1).alias("n"), F.concat(F.lit("lavfi.score="), F.col("value").cast("string")).alias("line"))
    return R.metadata_pairs(times.unionByName(values), "user_id", "n", "line", "lavfi.score")


@reg.add("src_silence_log", """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS "start", CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 5 ELSE 1000000 END AS DOUBLE) AS "end" FROM orders""")
def src_silence_log(t):
    """Silences of logs, those of odd orders without an end (SRC8)."""
    c = F.col("o_custkey")
    line = F.concat(F.lit("silence_start: "), c.cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nsilence_end: "), (c + 5).cast("string"))).otherwise(""))
    return R.silences(t.orders.select("o_orderkey", line.alias("log"), F.lit(1_000_000.0).alias("d")), "o_orderkey", "log", "d")


@reg.add("snk_manifest", f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT asset_id FROM assets)) AS asset_count, (SELECT {rd("sum(CAST(duration AS DECIMAL(24,6)))", 3)} FROM (SELECT DISTINCT asset_id, duration FROM assets)) AS total_duration, (SELECT count(DISTINCT scene_id) FROM scenes) AS scene_count""")
def snk_manifest(t):
    return K.manifest(t.assets, t.scenes)


@reg.add(
    "snk_subtitles",
    f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY s, utterance_id) AS number FROM {SPEECH}), m AS (SELECT *, greatest(0, CAST(round(CAST(s AS DECIMAL(24,12)) * 1000, 0) AS BIGINT)) AS a, greatest(0, CAST(round(CAST(e AS DECIMAL(24,12)) * 1000, 0) AS BIGINT)) AS b FROM x)
    SELECT asset_id, number, number || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, (a // 60000) % 60, (a // 1000) % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, (b // 60000) % 60, (b // 1000) % 60, b % 1000) || chr(10) || text AS block FROM m""",
)
def snk_subtitles(t):
    """Blocks of subtitle files per asset (SNK4)."""
    x = with_row_number(with_bucket(speech(t), "s"), ["asset_id"], "_b", ["s", "utterance_id"], "number")
    return K.subtitle_blocks(x, "asset_id", "number", "s", "e", "text")


def _revisions(t):
    """Scenes of an asset, taken as the clips of an edit, in two revisions."""
    clip = F.struct(F.col("scene_id").alias("id"), "scene_id", F.lit("a").alias("source"), F.col("s").alias("source_in"), F.col("e").alias("source_out"), F.col("label"), F.lit(1.0).alias("speed"))
    clips = scenes(t).groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "scene_id", clip.alias("c")))), lambda x: x["c"]).alias("clips"))
    first = clips.select(F.col("asset_id").alias("edit_id"), F.lit(1).alias("sequence"), F.concat("asset_id", F.lit("-1")).alias("revision_id"), "clips")
    return first.unionByName(first.filter(F.size("clips") > 2).withColumns({"sequence": F.lit(2), "revision_id": F.concat("edit_id", F.lit("-2")), "clips": E.remove_clip(E.move_clip(F.col("clips"), F.get("clips", F.lit(0))["id"], 1), F.get("clips", F.lit(2))["id"])}))


@reg.add(
    "e_revision_heads",
    f"""WITH r AS (SELECT asset_id, scene_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY s, scene_id) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM {SCENES})
    SELECT asset_id AS edit_id, asset_id || CASE WHEN any_value(n) >= 3 THEN '-2' ELSE '-1' END AS revision_id, string_agg(scene_id, ',' ORDER BY CASE WHEN n >= 3 THEN p ELSE k END) FILTER (WHERE n < 3 OR k <> 3) AS clips, {rd("CAST(sum(CAST(e - s AS DECIMAL(24,9))) FILTER (WHERE n < 3 OR k <> 3) AS DOUBLE)", 3)} AS seconds FROM r JOIN (SELECT asset_id, scene_id, CASE WHEN k = 1 THEN 2 WHEN k = 2 THEN 1 ELSE k END AS p FROM r) q USING (asset_id, scene_id) GROUP BY asset_id""",
)
def e_revision_heads(t):
    """The latest revision of each edit after a move and a removal, with its length (edit operations, A16, A17)."""
    h = E.heads(_revisions(t))
    return h.select("edit_id", "revision_id", F.array_join(F.transform("clips", lambda c: c["id"]), ",").alias("clips"), S.round_dec(E.duration(F.col("clips")), 3).alias("seconds"))


@reg.add("st_latest_state", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""")
def st_latest_state(t):
    """Latest state of each job (ST1)."""
    return J.latest_state(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "event_id"])


@reg.add(
    "st_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM y GROUP BY user_id, k""",
)
def st_sessions(t):
    """Sessions of users that six hours without an event end (EXT)."""
    s = J.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@reg.add("st_stage_status", """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 40 THEN 'failed' WHEN bool_and(event_type = 'click') THEN 'reused' ELSE 'completed' END AS status FROM events GROUP BY 1""")
def st_stage_status(t):
    """Status of a chain of stages (ST5)."""
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.every(F.col("event_type") == "click").alias("same"))
    st = n.select("user_id", F.when(F.col("bad") > 40, "failed").when(F.col("same"), "reused").otherwise("completed").alias("s"))
    return J.stage_status(st, "user_id", "s")


@reg.add("ext_rollup", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def ext_rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))


@reg.add(
    "ext_nation_revenue",
    f"""SELECT n_name, {rd("sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24,6)))", 2)} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""",
)
def ext_nation_revenue(t):
    """A star join with pruned columns and pushed filters."""
    li = t.lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(24,6)").alias("v"))
    o = t.orders.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(S.round_dec(F.sum("v"), 2).alias("revenue"))


@reg.add(
    "q_scene_evidence",
    f"""WITH c AS (SELECT asset_id, scene_id, s AS cs, e AS ce FROM {SCENES} WHERE highlighted), x AS (SELECT scene_id, utterance_id, requested_locale AS l, u.s, u.e, text FROM c JOIN {SPEECH} u ON u.asset_id = c.asset_id AND u.s < ce AND u.e > cs),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY s, utterance_id) AS k, row_number() OVER (PARTITION BY scene_id, l ORDER BY s, utterance_id) AS kl FROM x),
    v AS (SELECT scene_id, sample_id, ts, row_number() OVER (PARTITION BY scene_id ORDER BY ae DESC NULLS LAST, ts, sample_id) AS r FROM c JOIN {VISION} USING (asset_id) WHERE ts >= cs AND ts < ce), f AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ts, sample_id) AS k FROM v WHERE r <= 8)
    SELECT scene_id, 'caption' AS part, k AS place, utterance_id AS item, s AS "start", text AS note FROM k WHERE k <= 30 UNION ALL SELECT scene_id, 'candidate ' || l, kl, NULL, s, text FROM k WHERE kl <= 8 AND l IS NOT NULL
    UNION ALL SELECT scene_id, 'frame', k, CAST(sample_id AS VARCHAR), ts, CASE WHEN r = 1 THEN 'representative' ELSE 'key_moment' END FROM f UNION ALL SELECT scene_id, 'records', coalesce(n, 0), NULL, NULL, NULL FROM c LEFT JOIN (SELECT scene_id, count(*) AS n FROM x GROUP BY 1) USING (scene_id)""",
)
def q_scene_evidence(t):
    """What highlights rest on, the nested evidence laid out in rows (get_scene_evidence)."""
    c = scenes(t).filter("highlighted").select("asset_id", "scene_id", "title", F.col("s").alias("cs"), F.col("e").alias("ce"))
    x = cut_lineage(Q.scene_evidence(c, speech(t), vision(t).select("asset_id", "sample_id", "ts", "ae")))
    row = lambda part, item, start, note: ["scene_id", part.alias("part"), (F.col("p") + 1).cast("long").alias("place"), item.alias("item"), start.alias("start"), note.alias("note")]
    none = F.lit(None).cast("string")
    caps = x.select("scene_id", F.posexplode("captions").alias("p", "v")).select(*row(F.lit("caption"), F.col("v.id"), F.col("v.start"), F.col("v.text")))
    cand = x.select("scene_id", F.explode("candidates").alias("l", "vs")).select("scene_id", "l", F.posexplode("vs").alias("p", "v")).select(*row(F.concat(F.lit("candidate "), F.col("l")), none, F.col("v.start"), F.col("v.text")))
    frames = x.select("scene_id", F.posexplode("frames").alias("p", "v")).select(*row(F.lit("frame"), F.col("v.sample_id").cast("string"), F.col("v.time"), F.col("v.role")))
    counts = x.select("scene_id", (F.col("records") - 1).alias("p")).select(*row(F.lit("records"), none, F.lit(None).cast("double"), none))
    return caps.unionByName(cand).unionByName(frames).unionByName(counts)


@reg.add(
    "q_ui_context",
    f"""WITH a AS (SELECT DISTINCT asset_id, source_name, coalesce(creation_time, '9999') AS c, CASE WHEN length(creation_time) >= 10 THEN substr(creation_time, 1, 10) ELSE 'unknown' END AS day, duration, scene_count FROM assets),
    f AS (SELECT DISTINCT scene_id, asset_id, source_in, title FROM scenes WHERE scene_id IN (SELECT DISTINCT scene_id FROM scenes ORDER BY scene_id LIMIT 5)), m AS (SELECT asset_id FROM scenes WHERE scene_id = (SELECT min(scene_id) FROM scenes) LIMIT 1),
    o AS (SELECT asset_id, row_number() OVER (ORDER BY c, source_name, asset_id) - 1 AS i, count(*) OVER () AS n FROM a), p AS (SELECT greatest(0, least(n, greatest(0, i - 4) + 8) - 8) AS lo, least(n, greatest(0, i - 4) + 8) AS hi FROM o WHERE asset_id = (SELECT asset_id FROM m)),
    d AS (SELECT day, count(*) AS k FROM a GROUP BY 1 ORDER BY 1 LIMIT 31)
    SELECT 'selected' AS part, scene_id AS item, row_number() OVER (ORDER BY c, source_name, asset_id, {rd("source_in", 3)}, scene_id) - 1 AS place FROM f JOIN a USING (asset_id) UNION ALL SELECT 'nearby', asset_id, i FROM o, p WHERE i >= lo AND i < hi
    UNION ALL SELECT 'day', day, k FROM d UNION ALL SELECT 'asset', asset_id, i FROM o WHERE i < 100 UNION ALL SELECT 'days_truncated', CAST(count(DISTINCT day) > 31 AS VARCHAR), 0 FROM a UNION ALL SELECT 'assets_truncated', CAST(count(*) > 100 AS VARCHAR), 0 FROM a""",
)
def q_ui_context(t):
    """What a user with five scenes selected, the first one focused, sees (resolve_ui_context)."""
    ids = [r[0] for r in t.scenes.select("scene_id").distinct().orderBy("scene_id").limit(5).collect()]
    x = Q.resolve_ui_context(t.assets, t.scenes, {"focused_scene_id": ids[0] if ids else None, "selected_scene_ids": ids})
    placed = lambda df, c: [(r[c], i) for i, r in enumerate(df.select(c).collect())]
    rows = [("selected", *r) for r in placed(x["selected"], "scene_id")] + [("asset", *r) for r in placed(x["assets"], "asset_id")]
    rows += [("days_truncated", str(x["days_truncated"]).lower(), 0), ("assets_truncated", str(x["assets_truncated"]).lower(), 0)]
    days = x["days"].select(F.lit("day").alias("part"), F.col("capture_date").alias("item"), F.col("asset_count").alias("place"))
    near = x["nearby"].select(F.lit("nearby").alias("part"), F.col("asset_id").alias("item"), "place")
    return t.spark.createDataFrame(rows, "part string, item string, place long").unionByName(days).unionByName(near)


@reg.add(
    "q_search_highlights",
    r"""WITH s AS (SELECT DISTINCT scene_id, asset_id, title, search_text, notable_count, confidence, list_distinct(list_filter(regexp_extract_all(lower(search_text), '([\p{L}\p{N}_]+)', 1), lambda w: length(w) > 1)) AS st FROM scenes WHERE highlighted),
    x AS (SELECT *, len(list_intersect(st, ['다리', 'harbour', 'wall'])) AS o, contains(lower(search_text), 'harbour wall 다리') AS sub FROM s)
    SELECT scene_id, asset_id, title, """
    + rd("o * 2.0 + CASE WHEN sub THEN 2.5 ELSE 0.0 END + 0.8 + least(1.0, coalesce(notable_count, 0) * 0.4) + coalesce(confidence, 0.0) * 0.25", 6)
    + """ AS score FROM x WHERE o > 0 OR sub ORDER BY score DESC, scene_id LIMIT 30""",
)
def q_search_highlights(t):
    """Highlights that fit a query in two scripts (search_scenes)."""
    return Q.search_scenes(t.scenes, "harbour wall 다리", highlight_only=True, limit=30)


@reg.add("q_list_assets", """SELECT asset_id, source_name FROM (SELECT DISTINCT asset_id, source_name, creation_time FROM assets) WHERE length(creation_time) >= 10 AND starts_with(creation_time, '2025-0') ORDER BY creation_time, source_name, asset_id LIMIT 100""")
def q_list_assets(t):
    """Assets of the first months of a year (list_assets)."""
    return Q.list_assets(t.assets, "2025-0").select("asset_id", "source_name")


@reg.add(
    "m_average_hash",
    """WITH m AS (SELECT vec_id, embedding AS v, list_avg(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT))) AS m FROM embeddings),
    b AS (SELECT vec_id, list_transform(range(0, 16), lambda g: list_sum(list_transform(range(0, 4), lambda i: CASE WHEN CAST(round(v[g * 4 + i + 1] * 1000) AS BIGINT) >= m THEN CAST(pow(2, 3 - i) AS BIGINT) ELSE 0 END))) AS d FROM m)
    SELECT vec_id, array_to_string(list_transform(d, lambda x: substr('0123456789abcdef', CAST(x AS INT) + 1, 1)), '') AS hash FROM b""",
)
def m_average_hash(t):
    """Average hashes of 64 values, as of 8 x 8 luma (M5)."""
    luma = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return t.embeddings.select("vec_id", luma.alias("luma")).select("vec_id", S.average_hash("luma").alias("hash"))
