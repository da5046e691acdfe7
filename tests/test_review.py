"""Checks of reviews on small fixtures: each rule is broken by one row, and a sound table breaks none."""

import pytest
from pyspark.sql import functions as F

from framelode.operators import matching as M
from framelode.operators import review as R


def found(df):
    return {(r["entity_id"], r["message"]) for r in df.collect()}


def tables(spark, **rows):
    return {k: spark.createDataFrame(v[1], v[0]) for k, v in rows.items()}


def test_packet(spark):
    x = spark.createDataFrame([("a", i, 0.0, 10.0, "t") for i in "1234"] + [("a", "5", 0.0, 1.0, " ")], "asset string, item string, s double, e double, text string")
    f = spark.createDataFrame([("a", "1", 0.0, 4.0, False), ("a", "1", 4.0, 10.0, True), ("a", "2", 0.0, 4.0, True), ("a", "2", 5.0, 10.0, False), ("a", "3", 0.0, 10.0, True), ("a", "3", 0.0, 10.0, True), ("a", "5", 0.0, 1.0, False)], "asset string, item string, s double, e double, owner boolean")
    assert found(R.packet(x, f, "asset")) == {("4", "evidence in no window"), ("4", "text without exactly one owner"), ("2", "evidence isn't fully covered"), ("3", "text without exactly one owner")}
    assert found(R.packet(x.limit(0), f.limit(0), "asset")) == set()


def test_reconciled(spark):
    w = spark.createDataFrame([("a", "W1", 0.0, 8.0), ("a", "W2", 8.0, 16.0)], "asset string, window_id string, ws double, we double")
    u = spark.createDataFrame([("a", "W1", "ok", 0.0, 8.0005, "ko", "x"), ("a", "W1", "lang", 0.0, 1.0, "xx", "x"), ("a", "W1", "out", 0.0, 9.0, "en", "x"), ("a", "W1", "blank", 0.0, 1.0, "en", " "), ("a", "W1", "quiet", 0.0, 1.0, "non_speech", None), ("a", "W9", "lost", 0.0, 1.0, "en", "x"), ("a", "W1", "bare", 0.0, 1.0, "en", "x"), ("a", "W1", "alien", 0.0, 1.0, "en", "x"), ("a", "W1", "null", 0.0, 1.0, None, "x")], "asset string, window_id string, utterance_id string, s double, e double, language string, text string")
    s = spark.createDataFrame([(x, "c1") for x in ("ok", "lang", "out", "blank", "quiet", "lost", "null")] + [("alien", "c1"), ("alien", "c9")], "utterance_id string, source_id string")
    o = spark.createDataFrame([("W1", "c1"), ("W9", "c1")], "window_id string, source_id string")
    assert found(R.reconciled(w, u, s, o, "asset")) == {("W2", "window without review"), ("lang", "language isn't of the list"), ("null", "language isn't of the list"), ("out", "outside its window"), ("blank", "no text"), ("lost", "unknown window"), ("bare", "no source"), ("alien", "source wasn't offered")}


def test_captions(spark):
    u = spark.createDataFrame([("a", f"u{i}", 10.0 * i, 10.0 * i + 5, "ko") for i in range(9)] + [("a", "en", 11.0, 12.0, "en"), ("a", "bare", 1.0, 2.0, "ko")], "asset string, utterance_id string, us double, ue double, ul string")
    rows = [(0, "ok", 0.0, 5.0, "ko", "t"), (1, "mixed", 10.0, 14.0, "mixed", "t"), (2, "early", 18.9, 25.0, "ko", "t"), (3, "late", 30.0, 36.6, "ko", "t"), (4, "blank", 40.0, 45.0, "ko", ""), (5, "apart", 50.0, 60.0, "ko", "t"), (6, "tongue", 60.0, 65.0, "en", "t"), (7, "back", 49.0, 51.0, "ko", "t"), (8, "stray", 80.0, 85.0, "ko", "t"), (9, "out", 80.0, 101.0, "ko", "t"), (10, "twin", 81.0, 85.0, "ko", "t"), (11, "twin", 81.0, 85.0, "ko", "t")]
    r = spark.createDataFrame([("a", "g", *x) for x in rows], "asset string, grp string, number long, caption_id string, s double, e double, language string, text string")
    c = spark.createDataFrame([("ok", "u0"), ("mixed", "u1"), ("mixed", "en"), ("early", "u2"), ("late", "u3"), ("blank", "u4"), ("apart", "u5"), ("apart", "u6"), ("tongue", "u6"), ("back", "u5"), ("stray", "nobody"), ("stray", "u8"), ("out", "u8"), ("twin", "u8"), ("none", "u7")], "caption_id string, utterance_id string")
    whole = spark.createDataFrame([("a", 100.0)], "asset string, duration double")
    assert found(R.captions(r, u, c, whole, "asset", "grp")) == {
        ("early", "too far from its utterances"), ("late", "too far from its utterances"), ("blank", "no text"), ("apart", "doesn't overlap each utterance"), ("tongue", "language differs from its utterances"), ("back", "starts before the one before it"),
        ("stray", "cites an unknown utterance"), ("out", "outside the media"), ("out", "too far from its utterances"), ("twin", "id isn't unique"), ("bare", "utterance without caption"),
    }


def test_beats(spark):
    rows = [("b1", 0.0, 10.0, "none", "closed"), ("b2", 9.0, 20.0, "none", "closed"), ("b3", 20.0, 31.0, "extend_after", "open"), ("b4", 20.5, 20.5, "none", "open"), ("b5", 40.0, 50.0, "none", "closed"), ("b5", 50.0, 60.0, "none", "closed")]
    r = spark.createDataFrame([("a", "g1" if x[0] < "b5" else "g2", *x) for x in rows], "asset string, group_id string, beat_id string, s double, e double, adjustment string, closure string")
    g = spark.createDataFrame([("a", "g1", 0.0, 30.0), ("a", "g2", 41.0, 59.0)], "asset string, group_id string, gs double, ge double")
    anchors = spark.createDataFrame([("a", x) for x in (0.0, 10.0005, 9.0, 20.0, 31.0, 40.0, 50.0, 60.0)], "asset string, anchor double")
    c = spark.createDataFrame([("b1", "utterance", "u1"), ("b2", "utterance", "u1"), ("b2", "utterance", "u2"), ("b3", "caption", "c1")], "beat_id string, kind string, item string")
    i = spark.createDataFrame([("a", "g1", "utterance", "u1", 1.0, 2.0), ("a", "g1", "utterance", "u2", 19.0, 21.0), ("a", "g1", "caption", "c1", 21.0, 22.0), ("a", "g1", "caption", "c2", 21.0, 22.0)], "asset string, group_id string, kind string, item string, xs double, xe double")
    assert found(R.beats(r, g, anchors, c, i, "asset")) == {
        ("b2", "overlaps the beat before it"), ("b2", "cuts a utterance"), ("b4", "overlaps the beat before it"), ("b4", "no length"), ("b4", "edge without anchor"), ("b4", "open dialogue without adjustment"),
        ("b5", "id isn't unique"), ("b5", "crosses the start of its group"), ("b5", "crosses the end of its group"), ("u1", "utterance in several beats"), ("c2", "caption in no beat"),
    }


def test_clip_evidence(spark):
    cores = spark.createDataFrame([("a", "b1", 0.0, 10.0, 1.0, 9.0), ("a", "b2", 0.0, 10.0, 1.5, 9.0), ("a", "b3", 0.0, 10.0, 2.0, 11.0)], "asset string, beat_id string, s double, e double, a double, b double")
    anchors = spark.createDataFrame([("a", "b1", 1.0), ("a", "b1", 9.0), ("a", "b2", 9.0), ("a", "b3", 2.0), ("a", "b3", 11.0)], "asset string, beat_id string, anchor double")
    speech = spark.createDataFrame([("a", "b1", "u1", 1.0, 2.0), ("a", "b3", "u3", 1.0, 3.0)], "asset string, beat_id string, utterance_id string, us double, ue double")
    frames = spark.createDataFrame([("a", "b1", "f1", 1.0)], "asset string, beat_id string, sample_id string, t double")
    rows = [("ok", "subjects", "food", "visual", 0.0, 2.0, ["f1"], ["u1"]), ("late", "subjects", "food", "inferred", 5.0, 6.0, ["f1"], ["u1"]), ("none", "subjects", "food", "inferred", 0.0, 2.0, [], []), ("basis", "subjects", "food", None, 0.0, 2.0, ["f1"], []), ("deaf", "subjects", "food", "speech", 0.0, 2.0, ["f1"], []), ("blind", "subjects", "food", "visual", 0.0, 2.0, [], ["u1"])]
    rows += [("song", "audio", "music", "speech", 0.0, 2.0, [], ["u1"]), ("talk", "audio", "speech", "speech", 0.0, 2.0, [], ["u1"]), ("shake", "quality", "shaky", "speech", 0.0, 2.0, [], ["u1"]), ("alien", "subjects", "food", "visual", 0.0, 2.0, ["f9"], ["u9"]), ("wide", "subjects", "food", "visual", 0.0, 12.0, ["f1"], [])]
    claims = spark.createDataFrame([("a", "b1", *x) for x in rows], "asset string, beat_id string, claim_id string, section string, kind string, basis string, x double, y double, samples array<string>, utterances array<string>")
    assert found(R.clip_evidence(cores, anchors, speech, claims, frames, "asset")) == {
        ("b2", "core range without anchor"), ("b3", "core range outside its beat"), ("b3", "core range cuts speech"), ("late", "frame outside the claim"), ("late", "speech outside the claim"), ("none", "no basis or evidence"), ("basis", "no basis or evidence"), ("deaf", "evidence of another kind than the basis"),
        ("blind", "evidence of another kind than the basis"), ("song", "audio that nobody heard"), ("shake", "quality told from speech"), ("alien", "cites a frame of another beat"), ("alien", "cites speech of another beat"), ("wide", "claim outside its beat"),
    }


def test_edit_plan(spark):
    rows = [("ok", "m", 0.0, 10.0, 1.0, 0.0, 90, 0.5), ("fast", "m", 0.0, 10.0, 9.0, 0.0, 0, None), ("loud", "m", 0.0, 10.0, 1.0, 25.0, 0, 3.0), ("short", "m", 0.0, 2.0, 1.0, 0.0, 0, None), ("turn", "m", 5.0, 5.0, 1.0, 0.0, 45, 0.0), ("end", "m", 0.0, 20.3, 1.0, 0.0, 0, None), ("gone", "x", 0.0, 1.0, None, 0.0, 0, None), ("gone", "m", 0.0, 9.0, 1.0, 0.0, 0, 1.0)]
    c = spark.createDataFrame([("p", i, *x) for i, x in enumerate(rows)], "plan string, number long, clip_id string, source string, source_in double, source_out double, speed double, volume_db double, rotation long, transition double")
    assert found(R.edit_plan(c, spark.createDataFrame([("m", 20.0)], "source string, duration double"), "plan")) == {
        ("fast", "speed outside its limits"), ("loud", "gain outside its limits"), ("loud", "transition longer than a neighbour"), ("turn", "rotation isn't a right angle"), ("turn", "no length"), ("turn", "transition without length"), ("turn", "transition longer than a neighbour"),
        ("end", "ends after its source"), ("gone", "unknown source"), ("gone", "speed outside its limits"), ("gone", "id isn't unique"), ("gone", "transition after the last clip"),
    }


def test_settings():
    good = {k: (200 if "width" in k else 0.5) for k in R.SETTINGS}
    assert R.settings(good) == []
    bad = good | {"vision_interval": 0, "ffmpeg_scene_threshold": 1.5, "neighbor_context": -1, "feature_distance_quantile": 1.0, "visual_moment_thumbnail_width": 159, "ocr_interval": float("inf"), "motion_interval": None}
    assert set(R.settings(bad)) == {"vision_interval", "ffmpeg_scene_threshold", "neighbor_context", "feature_distance_quantile", "visual_moment_thumbnail_width", "ocr_interval", "motion_interval"}
    assert R.settings(good | {"neighbor_context": 0, "ffmpeg_scene_threshold": 1}) == []


def test_coarse_groups(spark):
    from framelode.functions.similarity import sequence_ratio

    text = "the bus climbs past the lake and everybody looks out of the windows at once"
    g = spark.createDataFrame([("a", "one", 40.0, "short"), ("a", "two", 40.0, text), ("a", "brief", 5.0, "")], "asset string, group_id string, seconds double, description string")
    r = spark.createDataFrame([("a", "one", "b1", 0.0, text), ("a", "two", "b2", 0.0, text), ("a", "two", "b3", 9.0, text + "!"), ("a", "two", "b4", 19.0, "x"), ("a", "two", "b5", 29.0, "x")], "asset string, group_id string, beat_id string, s double, summary string")
    got = {x["group_id"]: (x["beats"], x["flags"]) for x in R.coarseness(g, r, sequence_ratio, "asset").collect()}
    assert got == {"one": (1, ["long_group_without_subdivision", "short_scene_description"]), "two": (4, ["repeated_beat_summary", "near_duplicate_beat_summary"]), "brief": (0, [])}


def test_two_sides(spark):
    p = spark.createDataFrame([(1, "/v/Day 1/Clip.MP4"), (2, "/v/Day 2/clip.mp4"), (3, None)], "id int, path string")
    q = spark.createDataFrame([("x", "day 1/clip.mp4"), ("y", "CLIP.mp4"), ("z", ""), ("w", "/other/v/Day 1/Clip.MP4")], "k string, suffix string")
    assert {(r["id"], r["k"]) for r in M.suffix_matches(p, "path", q, "suffix").collect()} == {(1, "x"), (1, "y"), (2, "y")}
    d = spark.createDataFrame([("a", "d", True), ("b", "d", False), ("c", "d", True), ("e", "d", False)], "k string, v string, verified boolean")
    o = spark.createDataFrame([("a", "o", True), ("b", "o", False), ("c", "o", True), ("c", "p", False)], "k string, v string, accepted boolean")
    assert {tuple(r) for r in M.overridden(d, o, "k", "v").collect()} == {("a", "o", "override", None), ("b", None, None, "no accepted override and no verified default"), ("c", None, None, "overridden twice"), ("e", None, None, "no accepted override and no verified default")}
    with pytest.raises(ValueError):
        M.shard(p, "id", 3, 2)
    ids = spark.createDataFrame([(f"A{i:03d}",) for i in range(10)] * 2, "id string")
    assert {r["id"] for r in M.shard(ids, "id", 2, 4).collect()} == {"A001", "A005", "A009"}
    parts = spark.createDataFrame([("p",), ("q",), ("q",), ("s",)], "id string")
    merged, problems = M.merged_shards(parts, spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "id string, place int"), "id", "place")
    assert {tuple(r) for r in problems.collect()} == {("q", "in several shards"), ("r", "in no shard"), ("s", "not expected")}
    assert M.multiset_differences(parts, parts.distinct(), ["id"]).select("id", F.col("left").cast("int"), F.col("right").cast("int")).collect() == [("q", 2, 1)]
