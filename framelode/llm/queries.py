"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import cut_lineage
from .languages import mislabelled, train_on, wholly_in, with_segments
from .lookalike import canonical_text, look_alike_classes, look_alike_pairs
from .mixing import mixed
from .nearest import nearest_within
from .packing import fill_report, packed
from .reading import fit_levels, word_counts
from .repeats import repeated_runs
from .tokens import with_tokens
from .turns import clean_turns, roster_names, speaker_turns

reg = Registry()


def _runs(t):
    return repeated_runs(t.stt_candidates, ["asset_id", "requested_locale"], "start", "end", "utterance_id", "text")


@reg.add("p1_found")
def p1_found(t):
    return _runs(t).select("asset_id", F.col("first_id").alias("first_utterance_id"), F.col("last_id").alias("last_utterance_id"))


@reg.add("p1_runs")
def p1_runs(t):
    return _runs(t)


def _labelled(t):
    """Texts with a label: transcript records and documents, whole-row copies once."""
    said = t.stt_candidates.select(F.lit("stt_candidates").alias("source_table"), F.col("utterance_id").alias("record_key"), "asset_id", "text", F.col("selected_locale").alias("label"))
    docs = t.documents.select(F.lit("documents").alias("source_table"), F.col("doc_id").cast("string").alias("record_key"), "asset_id", "text", F.col("lang").alias("label"))
    return said.unionByName(docs)


def _segments(t):
    rows = _labelled(t)
    return with_segments(rows, "text", train_on(rows, "record_key", "text", "label"))


@reg.add("p2_found")
def p2_found(t):
    return mislabelled(_segments(t), "label").select("source_table", "record_key", "language").distinct()


@reg.add("p2_segments")
def p2_segments(t):
    """Every stretch with its language, confidence and place, and whether the asset's trip expects that language."""
    trips = t.assets.select("asset_id", "trip_id").dropDuplicates(["asset_id"]).join(t.trip_config.select("trip_id", "expected_languages"), "trip_id", "left")
    rows = _segments(t).select("source_table", "record_key", "asset_id", F.explode("segments").alias("s")).distinct()
    return rows.join(trips, "asset_id", "left").select("source_table", "record_key", F.col("s.language").alias("language"), F.col("s.confidence").alias("confidence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.array_contains("expected_languages", F.col("s.language")).alias("expected"))


def _turn_args(t):
    names = roster_names(t.speaker_roster, "speaker", ["label_ko"])
    rows = t.stt_candidates.withColumn("place", F.regexp_extract("utterance_id", r"([0-9]{1,18})$", 1).try_cast("long"))
    return rows, names


@reg.add("p3_found")
def p3_found(t):
    """Turns in the order of the stated start, equal ones by repaired time."""
    rows, names = _turn_args(t)
    turns = speaker_turns(rows, "asset_id", "start", "end", "utterance_id", "place", "text", names, stated=True)
    return turns.select("asset_id", "speaker", F.col("first_id").alias("first_utterance_id"), F.col("last_id").alias("last_utterance_id"))


@reg.add("p3_turns")
def p3_turns(t):
    rows, names = _turn_args(t)
    return clean_turns(rows, t.stt_spans, "asset_id", "start", "end", "utterance_id", "place", "text", names)


@reg.add("p4_found")
def p4_found(t):
    return look_alike_pairs(t.assets, "asset_id", ["source_name", "source_path"])


@reg.add("p4_classes")
def p4_classes(t):
    """Every spelling of a name or path that has several, with its assets and how many others each of them is linked to."""
    return look_alike_classes(t.assets, "asset_id", ["source_name", "source_path"])


@reg.add("p4_canonical_names")
def p4_canonical_names(t):
    rows = t.assets.select("asset_id", "source_name", "source_path").distinct()
    out = canonical_text(canonical_text(rows, "source_name", "canonical_name"), "source_path", "canonical_path")
    return out.select("asset_id", "canonical_name", "canonical_path")


@reg.add(
    "p5_found",
    """
    WITH l AS (
      SELECT DISTINCT 'ocr_lines' AS source_table, asset_id, line_id AS record_id, CAST(round("timestamp" * 1000000) AS BIGINT) AS t FROM ocr_lines
      UNION SELECT 'person_detections', asset_id, detection_id, CAST(round("timestamp" * 1000000) AS BIGINT) FROM person_detections),
    r AS (SELECT asset_id, CAST(round("timestamp" * 1000000) AS BIGINT) AS t, min(sample_id) AS sample_id FROM vision_samples WHERE "timestamp" IS NOT NULL GROUP BY ALL),
    b AS (SELECT l.*, r.t AS bt, r.sample_id AS bid FROM l ASOF LEFT JOIN r ON l.asset_id = r.asset_id AND l.t >= r.t WHERE l.t IS NOT NULL),
    a AS (SELECT b.*, r.t AS at2, r.sample_id AS aid FROM b ASOF LEFT JOIN r ON b.asset_id = r.asset_id AND b.t <= r.t)
    SELECT source_table, record_id, CASE WHEN aid IS NULL OR (bid IS NOT NULL AND t - bt <= at2 - t) THEN bid ELSE aid END AS sample_id
    FROM a WHERE least(coalesce(t - bt, 1000000000), coalesce(at2 - t, 1000000000)) <= 400000""",
)
def p5_found(t):
    lines = t.ocr_lines.select(F.lit("ocr_lines").alias("source_table"), "asset_id", F.col("line_id").alias("record_id"), "timestamp")
    people = t.person_detections.select(F.lit("person_detections").alias("source_table"), "asset_id", F.col("detection_id").alias("record_id"), "timestamp")
    return nearest_within(lines.unionByName(people), t.vision_samples, ["asset_id"], "timestamp", ["source_table", "record_id"], "timestamp", "sample_id", 0.4)


#: Rows of the tables of container kinds; more is refused, as the kinds become part of the plan.
MAX_KINDS = 1000


def _kinds(t):
    rows = t.pack_limits.filter("container_kind IS NOT NULL AND capacity_tokens > 0").distinct().limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"at most {MAX_KINDS} kinds of containers")
    return sorted((r["container_kind"], int(r["capacity_tokens"])) for r in rows)


def _sized(t):
    """Documents with their tokens; counted once, as every use would tokenise all texts again."""
    return cut_lineage(with_tokens(t.documents.select("doc_id", "source", "text"), "text").drop("text"))


@reg.add("p8_containers")
def p8_containers(t):
    return packed(_sized(t), "doc_id", "tokens", _kinds(t))


@reg.add("p8_fill")
def p8_fill(t):
    kinds = _kinds(t)
    return fill_report(packed(_sized(t), "doc_id", "tokens", kinds), kinds)


@reg.add("p9_draws")
def p9_draws(t):
    return mixed(_sized(t), t.mix_targets, "doc_id", "source", "tokens")[0]


@reg.add("p9_shares")
def p9_shares(t):
    return mixed(_sized(t), t.mix_targets, "doc_id", "source", "tokens")[1]


#: The least level that counts as grade 12, which raters give as whole numbers.
GRADE_12 = 11.5


def _levels(english, grades):
    """Documents wholly in English with their number of pieces between blanks, theta and level."""
    pieces = english.select("doc_id", "text", F.size(F.regexp_extract_all("text", F.lit(r"[^\s\p{Z}]+"), F.lit(0))).alias("pieces"))
    return fit_levels(word_counts(pieces, "doc_id", "text", "pieces"), grades, "doc_id", "grade").withColumnRenamed("_d", "doc_id")


@reg.add("p10_found")
def p10_found(t):
    docs = t.documents.select("doc_id", "text", F.col("lang").alias("label"))
    english = wholly_in(docs, "text", train_on(docs, "doc_id", "text", "label"), "en")
    return _levels(english, t.reading_labels).filter((F.col("pieces") >= 40) & (F.col("level") >= GRADE_12)).select("doc_id")


@reg.add("p10_levels")
def p10_levels(t):
    """Every document with its level or, as grades tell the levels of English texts only, the reason why it has none."""
    docs = t.documents.select("doc_id", "text", F.col("lang").alias("label"))
    spoken = cut_lineage(with_segments(docs, "text", train_on(docs, "doc_id", "text", "label")))
    said = F.array_distinct(F.transform("segments", lambda s: s["language"]))
    english = spoken.filter((F.size("segments") > 0) & F.forall("segments", lambda s: s["language"] == "en"))
    why = F.when(F.size(said) == 0, "no clause of any language").when(F.size(said) > 1, "several languages").when(F.get(said, F.lit(0)) != "en", "not in English")
    levels = _levels(english, t.reading_labels).select("doc_id", "theta", "level")
    return spoken.select("doc_id", why.alias("reason")).distinct().join(levels, "doc_id", "left").select("doc_id", "theta", "level", "reason")
