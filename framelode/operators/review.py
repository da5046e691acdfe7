"""Checks of reviewed tables against the evidence they cite, as tables of violations.

Each takes plain tables with the column names given in its docstring and reports every row that
breaks a rule; what one rule can't judge (a null, an unknown id) is left to the rule meant for it.
Tables may hold ids of many assets; ``asset`` names the column of them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import all_of, duplicates, violations
from .intervals import near_semi, shared_seconds, uncovered
from .ordered import with_bucket
from .sequence import with_next, with_previous

EPS = 0.001
# Languages of a review, lead and tail of captions in seconds, limits of clips.
LANGUAGES = ["ko", "en", "mixed", "uncertain", "non_speech"]
LEAD, TAIL = 1.0, 1.5
SPEED, GAIN, ROTATIONS, MEDIA_SLACK = (0.25, 8.0), (-60.0, 24.0), [0, 90, 180, 270], 0.2


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def packet(expected: DataFrame, fragments: DataFrame, asset: str, check: str = "packet") -> DataFrame:
    """Whether windows hold all evidence (V6).

    ``expected``: asset, item, s, e, text. ``fragments``: asset, item, s, e, owner, one row for each window that
    holds a part. Every item is in some window, its parts leave no hole of it, and if it
    has text exactly one part owns that.
    """
    n = expected.join(fragments.groupBy(asset, "item").agg(F.count("*").alias("_n"), F.count_if("owner").alias("_own")), [asset, "item"], "left")
    none = violations(n, check, asset, "item", F.col("_n").isNull(), "evidence in no window")
    owners = violations(n, check, asset, "item", (F.trim("text") != "") & (F.coalesce("_own", F.lit(0)) != 1), "text without exactly one owner")
    holes = uncovered(expected.filter("e > s").select(asset, "item", "s", "e"), fragments.select(asset, "item", "s", "e"), [asset, "item"], "s", "e")
    partly = violations(holes.join(fragments.select(asset, "item").distinct(), [asset, "item"], "left_semi"), check, asset, "item", F.lit(True), "evidence isn't fully covered")
    return all_of(none, owners, partly)


def reconciled(windows: DataFrame, utterances: DataFrame, sources: DataFrame, offered: DataFrame, asset: str, check: str = "reconciled") -> DataFrame:
    """A review of windows (V7).

    ``windows``: asset, window_id, ws, we. ``utterances``: asset, window_id, utterance_id, s, e, language, text.
    ``sources``: utterance_id, source_id. ``offered``: window_id, source_id. Windows are reviewed and known; an
    utterance has a language of the list, lies in its window, has text if it is in a language,
    and cites at least one source, all of them offered with its window.
    """
    u = utterances.join(windows, [asset, "window_id"], "left")
    unreviewed = violations(windows.join(utterances, [asset, "window_id"], "left_anti"), check, asset, "window_id", F.lit(True), "window without review")
    cited = utterances.select(asset, "window_id", "utterance_id").join(sources, "utterance_id", "left")
    at = lambda d, broken, message: violations(d, check, asset, "utterance_id", broken, message)
    return all_of(
        unreviewed,
        at(u, F.col("ws").isNull(), "unknown window"),
        at(u, _no(F.col("language").isin(LANGUAGES)), "language isn't of the list"),
        at(u, (F.col("s") < F.col("ws") - EPS) | (F.col("e") > F.col("we") + EPS) | (F.col("e") <= F.col("s")), "outside its window"),
        at(u, _no(F.col("language").isin("uncertain", "non_speech")) & (F.trim(F.coalesce("text", F.lit(""))) == ""), "no text"),
        at(cited, F.col("source_id").isNull(), "no source"),
        at(cited.filter("source_id IS NOT NULL").join(offered, ["window_id", "source_id"], "left_anti").select(asset, "utterance_id").distinct(), F.lit(True), "source wasn't offered"),
    )


def captions(rows: DataFrame, utterances: DataFrame, cites: DataFrame, whole: DataFrame, asset: str, group: str, check: str = "captions") -> DataFrame:
    """Captions against the utterances they cite.

    ``rows``: asset, group, number, caption_id, s, e, language, text. ``utterances``: asset, utterance_id, us, ue, ul. ``cites``:
    caption_id, utterance_id. ``whole``: asset, duration. Ids are unique; a caption has text, lies in
    the media, doesn't start before the one before it (in the order of ``number``), leads its
    utterances by at most a second, trails them by at most one and a half, overlaps each of them, cites
    known ones only, and is in their one language or mixed. Every utterance has a caption.
    """
    found = rows.select(asset, "caption_id", "s", "e", "language").join(cites, "caption_id", "left").join(utterances, [asset, "utterance_id"], "left")
    of = found.groupBy(asset, "caption_id", "s", "e", "language").agg(
        F.count("us").alias("_n"), F.count("*").alias("_all"), F.min("us").alias("_from"), F.max("ue").alias("_to"), F.countDistinct("ul").alias("_langs"), F.min("ul").alias("_lang"),
        F.max((F.col("s") >= F.col("ue")) | (F.col("e") <= F.col("us"))).alias("_apart"),
    ).join(whole, asset, "left")
    order = with_previous(rows.select(asset, group, "number", "caption_id", "s").withColumn("_b", F.floor(F.col("number") / 1000).cast("long")), [asset, group], "_b", ["number", "caption_id"], ["s"], "_p")
    at = lambda d, broken, message: violations(d, check, asset, "caption_id", broken, message)
    early = F.col("s") < F.greatest(F.lit(0.0), F.col("_from") - LEAD) - EPS
    late = F.col("e") > F.least(F.col("duration"), F.col("_to") + TAIL) + EPS
    return all_of(
        duplicates(rows, asset, "caption_id", check),
        at(rows, F.trim(F.coalesce("text", F.lit(""))) == "", "no text"),
        at(of, (F.col("s") < 0) | (F.col("e") <= F.col("s")) | (F.col("e") > F.col("duration") + EPS), "outside the media"),
        at(order, F.col("s") < F.col("_p.s"), "starts before the one before it"),
        at(of, F.col("_n") < F.col("_all"), "cites an unknown utterance"),
        at(of, early | late, "too far from its utterances"),
        at(of, F.col("_apart"), "doesn't overlap each utterance"),
        at(of, (F.col("_n") > 0) & _no(F.col("language") == F.when(F.col("_langs") == 1, F.col("_lang")).otherwise("mixed")), "language differs from its utterances"),
        violations(utterances.join(cites, "utterance_id", "left_anti"), check, asset, "utterance_id", F.lit(True), "utterance without caption"),
    )


def beats(rows: DataFrame, groups: DataFrame, anchors: DataFrame, cites: DataFrame, items: DataFrame, asset: str, check: str = "beats") -> DataFrame:
    """Editorial beats of groups.

    ``rows``: asset, group_id, beat_id, s, e, adjustment, closure. ``groups``: asset, group_id, gs, ge. ``anchors``: asset,
    anchor. ``cites``: beat_id, kind, item. ``items``: asset, group_id, kind, item, xs, xe, what a group's beats must cover.
    Ids are unique; a beat has a length, doesn't overlap the one before it in its group, has both
    edges on an anchor (a millisecond of slack), stays in its group unless it is adjusted, and
    cuts no item it cites; open dialogue is adjusted. Each item is cited by exactly one beat of its group.
    """
    b = rows.join(groups, [asset, "group_id"], "left")
    order = with_previous(with_bucket(rows, "s"), [asset, "group_id"], "_b", ["s", "beat_id"], ["e"], "_p")
    edges = rows.select(asset, "beat_id", F.explode(F.array("s", "e")).alias("edge"))
    loose = edges.join(near_semi(edges.distinct(), anchors.distinct(), asset, "edge", "anchor", EPS), [asset, "beat_id", "edge"], "left_anti").select(asset, "beat_id").distinct()
    cited = rows.select(asset, "group_id", "beat_id", "s", "e").join(cites, "beat_id")
    of = cited.join(items, [asset, "group_id", "kind", "item"])
    count = items.join(cited.groupBy(asset, "group_id", "kind", "item").agg(F.count("*").alias("_n")), [asset, "group_id", "kind", "item"], "left")
    at = lambda d, broken, message: violations(d, check, asset, "beat_id", broken, message)
    return all_of(
        duplicates(rows, asset, "beat_id", check),
        at(rows, F.col("e") <= F.col("s"), "no length"),
        at(order, F.col("s") < F.col("_p.e") - EPS, "overlaps the beat before it"),
        at(loose, F.lit(True), "edge without anchor"),
        at(b, (F.col("s") < F.col("gs") - EPS) & _no(F.col("adjustment").isin("extend_before", "merge_previous")), "crosses the start of its group"),
        at(b, (F.col("e") > F.col("ge") + EPS) & _no(F.col("adjustment").isin("extend_after", "merge_next")), "crosses the end of its group"),
        at(rows, (F.col("closure") == "open") & (F.col("adjustment") == "none"), "open dialogue without adjustment"),
        at(of.filter((F.col("xs") < F.col("s") - EPS) | (F.col("xe") > F.col("e") + EPS)).select(asset, "beat_id", "kind").distinct(), F.lit(True), F.concat(F.lit("cuts a "), F.col("kind"))),
        violations(count, check, asset, "item", F.col("_n").isNull(), F.concat(F.col("kind"), F.lit(" in no beat"))),
        violations(count, check, asset, "item", F.col("_n") > 1, F.concat(F.col("kind"), F.lit(" in several beats"))),
    )


def clip_evidence(cores: DataFrame, anchors: DataFrame, speech: DataFrame, claims: DataFrame, frames: DataFrame, asset: str, check: str = "clip_evidence") -> DataFrame:
    """Evidence of clips.

    ``cores``: asset, beat_id, s, e, a, b (the beat and its core range). ``anchors``: asset, beat_id, anchor. ``speech``: asset, beat_id,
    utterance_id, us, ue, what the beat cites. ``claims``: asset, beat_id, claim_id, section, kind, basis, x, y, samples, utterances
    (arrays of ids). ``frames``: asset, beat_id, sample_id, t. A core range lies in its beat, on anchors, and cuts
    no speech. A claim lies in its beat, cites frames of its range and speech that overlaps it, both of its
    beat, and has the evidence its basis names; audio other than speech is inferred, and
    quality isn't told from speech.
    """
    edges = cores.select(asset, "beat_id", F.explode(F.array("a", "b")).alias("edge")).distinct()
    held = edges.join(anchors.distinct(), [asset, "beat_id"]).filter(F.abs(F.col("edge") - F.col("anchor")) <= EPS).select(asset, "beat_id", "edge").distinct()
    loose = edges.join(held, [asset, "beat_id", "edge"], "left_anti").select(asset, "beat_id").distinct()
    cut = cores.join(speech, [asset, "beat_id"]).filter((F.greatest("a", "us") < F.least("b", "ue")) & ((F.col("a") > F.col("us") + EPS) | (F.col("b") < F.col("ue") - EPS)))
    c = claims.join(cores.select(asset, "beat_id", "s", "e"), [asset, "beat_id"], "left")
    fs = claims.select(asset, "beat_id", "claim_id", "x", "y", F.explode("samples").alias("sample_id")).join(frames, [asset, "beat_id", "sample_id"], "left")
    us = claims.select(asset, "beat_id", "claim_id", "x", "y", F.explode("utterances").alias("utterance_id")).join(speech, [asset, "beat_id", "utterance_id"], "left")
    seen, heard = F.size("samples") > 0, F.size("utterances") > 0
    at = lambda d, broken, message, of="claim_id": violations(d, check, asset, of, broken, message)
    return all_of(
        at(cores, (F.col("a") < F.col("s") - EPS) | (F.col("b") > F.col("e") + EPS) | (F.col("b") <= F.col("a")), "core range outside its beat", "beat_id"),
        at(loose, F.lit(True), "core range without anchor", "beat_id"),
        at(cut.select(asset, "beat_id").distinct(), F.lit(True), "core range cuts speech", "beat_id"),
        at(c, (F.col("x") < F.col("s") - EPS) | (F.col("y") > F.col("e") + EPS) | (F.col("y") <= F.col("x")), "claim outside its beat"),
        at(fs, F.col("t").isNull(), "cites a frame of another beat"),
        at(fs, (F.col("t") < F.col("x") - EPS) | (F.col("t") > F.col("y") + EPS), "frame outside the claim"),
        at(us, F.col("us").isNull(), "cites speech of another beat"),
        at(us, F.greatest("x", "us") >= F.least("y", "ue"), "speech outside the claim"),
        at(claims, _no(F.col("basis").isin("visual", "speech", "inferred")) | ~(seen | heard), "no basis or evidence"),
        at(claims, ((F.col("basis") == "visual") & ~seen) | ((F.col("basis") == "speech") & ~heard), "evidence of another kind than the basis"),
        at(claims, (F.col("section") == "audio") & ((F.col("basis") == "visual") | ((F.col("kind") != "speech") & (F.col("basis") != "inferred"))), "audio that nobody heard"),
        at(claims, (F.col("section") == "quality") & (F.col("basis") == "speech"), "quality told from speech"),
    )


def edit_plan(clips: DataFrame, media: DataFrame, plan: str, check: str = "edit_plan") -> DataFrame:
    """Clips of edit plans.

    ``clips``: plan, number, clip_id, source, source_in, source_out, speed, volume_db, rotation, transition (seconds, null for none). ``media``:
    source, duration. Ids are unique; sources are known; a range has a length, starts at zero or later and ends with the
    media (0.2 s of slack); speed, gain and rotation are within their limits; a transition has a length, is
    shorter than both neighbours on the output, and doesn't follow the last clip.
    """
    length = (F.col("source_out") - F.col("source_in")) / F.col("speed")
    x = clips.withColumns({"_len": length, "_b": F.floor(F.col("number") / 1000).cast("long")})
    x = with_next(x, [plan], "_b", ["number", "clip_id"], ["_len"], "_n").join(media, "source", "left")
    at = lambda broken, message: violations(x, check, plan, "clip_id", broken, message)
    return all_of(
        duplicates(clips, plan, "clip_id", check),
        at(F.col("duration").isNull(), "unknown source"),
        at((F.col("source_out") <= F.col("source_in")) | (F.col("source_in") < 0), "no length"),
        at(F.col("source_out") > F.col("duration") + MEDIA_SLACK, "ends after its source"),
        at(_no(F.col("speed").between(*SPEED)), "speed outside its limits"),
        at(_no(F.col("volume_db").between(*GAIN)), "gain outside its limits"),
        at(_no(F.col("rotation").isin(ROTATIONS)), "rotation isn't a right angle"),
        at(F.col("transition").isNotNull() & F.col("_n").isNull(), "transition after the last clip"),
        at(F.col("transition") <= 0, "transition without length"),
        at(F.col("transition") >= F.least("_len", "_n._len"), "transition longer than a neighbour"),
    )


#: Roles of visual moments. Fixed values.
ROLES = ["visual", "action", "candid"]


def moments(rows: DataFrame, speech: DataFrame, whole: DataFrame, asset: str, check: str = "moments") -> DataFrame:
    """Visual moments.

    ``rows``: asset, moment_id, s, e, at (time of the representative), roles, primary_role, score, confidence, speech_seconds, speech_free. ``speech``:
    asset, s, e, periods that don't overlap. ``whole``: asset, duration. Ids are unique; a moment lies in the media and has a length, its
    representative lies in it, its roles are of the list and hold the primary one, score and confidence are 0 to 1, and its
    seconds of speech are those of the periods (a millisecond of slack) and decide whether it is free of speech.
    """
    x = rows.join(whole, asset, "left")
    p = speech.select(asset, F.col("s").alias("_ps"), F.col("e").alias("_pe"))
    said = shared_seconds(rows.select(asset, "moment_id", "s", "e"), p, asset, "moment_id", ("s", "e"), ("_ps", "_pe")).select(asset, "moment_id", "shared")
    y = rows.join(said, [asset, "moment_id"], "left")
    at = lambda d, broken, message: violations(d, check, asset, "moment_id", broken, message)
    return all_of(
        duplicates(rows, asset, "moment_id", check),
        at(x, (F.col("s") < 0) | (F.col("e") <= F.col("s")) | (F.col("e") > F.col("duration") + EPS), "outside the media"),
        at(rows, (F.col("at") < F.col("s") - EPS) | (F.col("at") > F.col("e") + EPS), "representative outside it"),
        at(rows, (F.size("roles") == 0) | (F.size(F.array_except("roles", F.array(*map(F.lit, ROLES)))) > 0), "role isn't of the list"),
        at(rows, ~F.array_contains("roles", F.col("primary_role")), "primary role isn't among its roles"),
        at(rows, _no(F.col("score").between(0, 1)) | _no(F.col("confidence").between(0, 1)), "score or confidence outside 0 to 1"),
        at(y, F.abs(F.col("speech_seconds") - F.col("shared")) > EPS, "seconds of speech differ"),
        at(y, F.col("speech_free") != (F.col("shared") <= EPS), "freedom of speech differs"),
    )


def summaries(rows: DataFrame, events: DataFrame, groups: DataFrame, asset: str, check: str = "summary") -> DataFrame:
    """Video summaries.

    ``rows``: asset, title, highlights (array of group ids), tags (array). ``events``: asset, place, group_id, headline. ``groups``: asset, place, group_id.
    A summary has a title, at most three different known highlights and one to eight tags that aren't blank; its events are
    the groups in their order, each with a headline.
    """
    pair = events.select(asset, "place", F.col("group_id").alias("_e")).join(groups.select(asset, "place", F.col("group_id").alias("_g")), [asset, "place"], "full_outer")
    named = rows.select(asset, F.explode("highlights").alias("group_id")).join(groups, [asset, "group_id"], "left_anti").distinct()
    at = lambda d, broken, message: violations(d, check, asset, asset, broken, message)
    return all_of(
        at(rows, F.trim(F.coalesce("title", F.lit(""))) == "", "no title"),
        at(rows, (F.size("highlights") > 3) | (F.size(F.array_distinct("highlights")) < F.size("highlights")), "more than three highlights or one named twice"),
        violations(named, check, asset, "group_id", F.lit(True), "unknown highlight"),
        at(rows, ~F.size("tags").between(1, 8) | F.exists("tags", lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""), "tags are one to eight, none blank"),
        at(pair.filter(~F.col("_e").eqNullSafe(F.col("_g"))).select(asset).distinct(), F.lit(True), "events aren't the groups in order"),
        violations(events, check, asset, "group_id", F.trim(F.coalesce("headline", F.lit(""))) == "", "event without headline"),
    )


def proxies(sources: DataFrame, copies: DataFrame, key: str, *, largest: int = 1280) -> DataFrame:
    """key, reasons: what is wrong with proxies (V19). Both tables: key, codec, width, height, duration, fps, audio (null for none).

    H.264, no side over ``largest``, duration within half a second or a thousandth, frame rate within 0.02, sound as in the source.
    Sources without a proxy aren't listed.
    """
    a = sources.select(key, *(F.col(c).alias(f"_{c}") for c in ("duration", "fps", "audio")))
    x = copies.join(a, key)
    bad_size = _no((F.col("width") > 0) & (F.col("height") > 0) & (F.greatest("width", "height") <= largest))
    why = F.array(
        F.when(_no(F.col("codec") == "h264"), "codec"), F.when(bad_size, "dimensions"), F.when(F.abs(F.col("duration") - F.col("_duration")) > F.greatest(F.lit(0.5), F.col("_duration") * 0.001), "duration"),
        F.when(F.abs(F.col("fps") - F.col("_fps")) > 0.02, "frame_rate"), F.when(F.col("audio").isNull() != F.col("_audio").isNull(), "audio"),
    )
    return x.select(key, F.array_compact(why).alias("reasons")).filter(F.size("reasons") > 0)


def coarseness(groups: DataFrame, rows: DataFrame, ratio, asset: str) -> DataFrame:
    """asset, group_id, beats, flags: groups to look at again.

    ``groups``: asset, group_id, seconds, description. ``rows``: asset, group_id, beat_id, s, summary. ``ratio`` compares two texts. Flags: a group of half a
    minute in one beat, or with under 60 characters of description; a summary that two beats share; neighbours whose
    summaries of 60 characters or more are alike by 0.85 and not the same.
    """
    b = with_previous(with_bucket(rows, "s").withColumn("_t", F.trim(F.coalesce("summary", F.lit("")))), [asset, "group_id"], "_b", ["s", "beat_id"], ["_t"], "_p")
    long = (F.length("_t") >= 60) & (F.length("_p._t") >= 60) & (F.col("_t") != F.col("_p._t"))
    near = b.filter(long).select(asset, "group_id", ratio(F.col("_p._t"), F.col("_t")).alias("_r")).filter("_r >= 0.85").select(asset, "group_id").distinct().withColumn("_near", F.lit(True))
    n = b.groupBy(asset, "group_id").agg(F.count("*").alias("beats"))
    twice = b.filter("_t <> ''").groupBy(asset, "group_id", "_t").agg(F.count("*").alias("_n")).filter("_n > 1").select(asset, "group_id").distinct().withColumn("_twice", F.lit(True))
    x = groups
    for side in (n, twice, near):
        x = x.join(side, [asset, "group_id"], "left")
    half = F.col("seconds") >= 30
    flags = F.array(
        F.when((F.coalesce("beats", F.lit(0)) <= 1) & half, "long_group_without_subdivision"), F.when(F.col("_twice"), "repeated_beat_summary"), F.when(F.col("_near"), "near_duplicate_beat_summary"),
        F.when((F.length(F.trim(F.coalesce("description", F.lit("")))) < 60) & half, "short_scene_description"),
    )
    return x.select(asset, "group_id", F.coalesce("beats", F.lit(0)).alias("beats"), F.array_compact(flags).alias("flags"))


def review_reasons(cores: DataFrame, said: DataFrame, key: list[str]) -> DataFrame:
    """key, reasons: why a clip should be looked at.

    ``cores``: key, a, b (its range), evidence (whether it has any), closure, adjustment, dialogue. ``said``: key, s, e, text, its captions and utterances.
    """
    cut = (F.greatest("a", "s") < F.least("b", "e")) & ((F.col("s") < F.col("a") - EPS) | (F.col("e") > F.col("b") + EPS))
    unsure = F.col("text").contains("…") | F.col("text").contains("...")
    of = cores.select(*key, "a", "b").join(said, key).groupBy(*key).agg(F.max(F.coalesce(unsure, F.lit(False))).alias("_unsure"), F.max(cut).alias("_cut"))
    why = F.array(
        F.when(_no(F.col("evidence")), "editorial_evidence_missing").when(_no(F.col("closure") == "closed"), "event_closure_unconfirmed"), F.when(_no(F.col("adjustment") == "none"), "neighbor_boundary_review"),
        F.when(F.col("dialogue") == "open", "dialogue_open"), F.when(F.col("_unsure"), "caption_uncertainty"), F.when(F.col("_cut"), "speech_boundary_cut"),
    )
    return cores.join(of, key, "left").select(*key, F.array_compact(why).alias("reasons"))


#: Settings of boundary detection with their bounds: greater than, at most (null for none), whether the lower bound itself is allowed. Fixed values.
SETTINGS = {
    "vision_interval": (0, None, False), "ocr_interval": (0, None, False), "motion_interval": (0, None, False), "cluster_tolerance": (0, None, False), "visual_moment_window": (0, None, False), "visual_moment_nms": (0, None, False), "visual_moments_per_minute": (0, None, False),
    "ffmpeg_scene_threshold": (0, 1, False), "neighbor_context": (0, None, True), "feature_distance_floor": (0, None, True), "visual_moment_thumbnail_width": (160, None, True), "feature_distance_quantile": (0, 0.999999, False), "motion_delta_quantile": (0, 0.999999, False),
}


def settings(values: dict[str, float]) -> list[str]:
    """Names of the settings that are missing, no number, or outside their bounds."""
    bad = []
    for name, (low, high, closed) in SETTINGS.items():
        v = values.get(name)
        ok = isinstance(v, (int, float)) and math.isfinite(v) and (v >= low if closed else v > low) and (high is None or v <= high)
        if not ok:
            bad.append(name)
    return bad


def hand_over(states: DataFrame, files: DataFrame, current: DataFrame, asset: str, *, schema: str, policy: dict[str, str], check: str = "hand_over") -> DataFrame:
    """Prepared assets before they are handed over.

    ``states``: asset, schema_version, stated_id, policy (map). ``files``: asset, path, digest, as recorded. ``current``: path, digest, as they are now. The schema
    and every value of the policy are as given, the state is that of its asset, and each recorded file is there unchanged.
    """
    f = files.join(current.select("path", F.col("digest").alias("_now")), "path", "left")
    wrong = F.lit(False)
    for k, v in policy.items():
        wrong = wrong | _no(F.try_element_at("policy", F.lit(k)) == v)
    at = lambda broken, message: violations(states, check, asset, asset, broken, message)
    return all_of(
        at(_no(F.col("schema_version") == schema), "schema differs"),
        at(_no(F.col("stated_id") == F.col(asset)), "state of another asset"),
        at(wrong, "policy differs"),
        violations(f, check, asset, "path", F.col("_now").isNull(), "file is gone"),
        violations(f, check, asset, "path", F.col("_now") != F.col("digest"), "file has changed"),
        violations(states.join(files, asset, "left_anti"), check, asset, asset, F.lit(True), "no file recorded"),
    )


def in_order(machine: DataFrame, reviewed: DataFrame, asset: str, check: str = "review_order") -> DataFrame:
    """A review keeps the machine's order, and its groups hold each segment once, without a gap (V2).

    ``machine``: asset, place, segment_id. ``reviewed``: asset, place, segment_id, group_id, one row for each group that names the segment.
    """
    r = reviewed.groupBy(asset, "segment_id").agg(F.min("place").alias("_at"), F.count("group_id").alias("_n"))
    x = machine.join(r, [asset, "segment_id"], "left")
    g = reviewed.filter("group_id IS NOT NULL").join(machine.select(asset, "segment_id", F.col("place").alias("_m")), [asset, "segment_id"]).groupBy(asset, "group_id").agg((F.max("_m") - F.min("_m") + 1).alias("_wide"), F.countDistinct("segment_id").alias("_n"))
    at = lambda broken, message: violations(x, check, asset, "segment_id", broken, message)
    return all_of(
        at(F.col("_at").isNull(), "not reviewed"),
        at(F.col("_at") != F.col("place"), "in another place"),
        at(F.col("_n") == 0, "in no group"),
        at(F.col("_n") > 1, "in several groups"),
        violations(g, check, asset, "group_id", F.col("_wide") > F.col("_n"), "group with a gap"),
    )
