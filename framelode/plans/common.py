"""Views of the input tables that the catalogue's queries share, as DataFrames and as SQL.

Whole-row copies count as one record everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rd(x: str, digits: int) -> str:
    """SQL twin of ``round_dec``."""
    return f"CAST(round(CAST({x} AS DECIMAL(24,12)), {digits}) AS DOUBLE)"


def speech(t) -> DataFrame:
    """Transcript records with valid bounds and words."""
    rows = t.stt_candidates.select("asset_id", "utterance_id", "requested_locale", F.col("start").alias("s"), F.col("end").alias("e"), "text", F.col("mean_confidence").alias("conf")).distinct()
    return rows.filter("e > s AND text IS NOT NULL AND trim(text) <> ''")


SPEECH = """(SELECT DISTINCT asset_id, utterance_id, requested_locale, "start" AS s, "end" AS e, text, mean_confidence AS conf FROM stt_candidates
 WHERE "end" > "start" AND text IS NOT NULL AND trim(text) <> '')"""


def scenes(t) -> DataFrame:
    """Scenes with valid bounds."""
    return t.scenes.select("scene_id", "asset_id", "group_id", F.col("source_in").alias("s"), F.col("source_out").alias("e"), "title", "label", "summary", "notable_count", "confidence", "highlighted", "search_text", "creation_time", "tags").distinct().filter("e > s")


SCENES = """(SELECT DISTINCT scene_id, asset_id, group_id, source_in AS s, source_out AS e, title, label, summary, notable_count, confidence, highlighted, search_text, creation_time, tags
 FROM scenes WHERE source_out > source_in)"""


def vision(t) -> DataFrame:
    """Vision samples with a time."""
    return t.vision_samples.select("asset_id", "sample_id", F.col("timestamp").alias("ts"), F.col("feature_distance").alias("fd"), F.col("aesthetics_score").alias("ae"), "is_utility", "face_count", "person_count").distinct().filter("ts IS NOT NULL")


VISION = """(SELECT DISTINCT asset_id, sample_id, "timestamp" AS ts, feature_distance AS fd, aesthetics_score AS ae, is_utility, face_count, person_count
 FROM vision_samples WHERE "timestamp" IS NOT NULL)"""


def ocr(t) -> DataFrame:
    return t.ocr_lines.select("asset_id", "line_id", F.col("timestamp").alias("ts"), "text", F.col("confidence").alias("conf")).distinct().filter("ts IS NOT NULL")


OCR = """(SELECT DISTINCT asset_id, line_id, "timestamp" AS ts, text, confidence AS conf FROM ocr_lines WHERE "timestamp" IS NOT NULL)"""


def people(t) -> DataFrame:
    return t.person_detections.select("asset_id", "detection_id", F.col("timestamp").alias("ts"), "kind", "bounding_box", F.col("confidence").alias("conf")).distinct().filter("ts IS NOT NULL")


PEOPLE = """(SELECT DISTINCT asset_id, detection_id, "timestamp" AS ts, kind, bounding_box, confidence AS conf FROM person_detections WHERE "timestamp" IS NOT NULL)"""


def spans(t) -> DataFrame:
    return t.stt_spans.select("asset_id", "utterance_id", "span_index", F.col("start").alias("ss"), F.col("end").alias("se"), F.col("text").alias("span_text"), F.col("confidence").alias("span_conf")).distinct()


SPANS = """(SELECT DISTINCT asset_id, utterance_id, span_index, "start" AS ss, "end" AS se, text AS span_text, confidence AS span_conf FROM stt_spans)"""
