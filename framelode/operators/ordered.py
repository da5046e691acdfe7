"""Ordered rules that carry state: suppression, clustering, segmentation, lines, accepted speech.

Most are chains of segment starts or suppression (``chains``). The one fold left keeps a group
of rows in one array; groups are first cut into islands at places where the rule provably forgets
its state (a pause), so that an array holds one island, not a key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .chains import chained, first_beyond, first_from, suppressed
from .sequence import with_last_known, with_next, with_previous, with_row_number, with_running_max, with_running_sum

#: Weight of a kind of signal in ranking and fusion, and that of kinds not named. Fixed values.
KIND_WEIGHTS = {
    "hard_cut": 1.25, "speech_start": 1.12, "speech_end": 1.12, "silence_gap": 1.08, "visual_change": 1.0, "motion_change": 0.92,
    "face_presence_change": 0.9, "person_presence_change": 0.9, "ocr_change": 0.88, "quality_change": 0.75, "speech_segment_boundary": 0.72,
}
OTHER_WEIGHT = 0.8


def with_bucket(df: DataFrame, time: str, width: float = 600.0) -> DataFrame:
    """Add ``_b``, the bucket of ``time`` for look-back; rows without a time are left out."""
    return df.filter(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double"))).withColumn("_b", F.floor(F.col(time) / width).cast("long"))


def ordered_fold(df: DataFrame, keys: list[str], order: list[Column], fields: list[str], init: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """keys and ``name``: the state after all rows of each group in order; the fold runs in the JVM."""
    packed = F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("row"))))
    return df.groupBy(*keys).agg(packed.alias("_rows")).select(*keys, F.aggregate("_rows", init, lambda acc, x: step(acc, x["row"])).alias(name))


def kind_weight(kind) -> Column:
    table = F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(kind) if isinstance(kind, str) else kind), F.lit(OTHER_WEIGHT))


def suppress(events: DataFrame, keys: list[str], time: str, score: str, id_col: str, tolerance: float, *, inclusive: bool = True) -> DataFrame:
    """Greedy non-maximum suppression (W11-W13): keys, time, score, id of the kept events.

    Events are taken by falling score, then time, then id; one is kept if no kept one lies
    within ``tolerance`` (or, not ``inclusive``, nearer). Add the kind to ``keys`` to suppress within
    kinds. Null times are left out, null scores come last; ties go by time and id; repeated rows
    count once.
    """
    rows = with_bucket(events.select(*keys, F.col(time).cast("double").alias("_t"), F.col(score).cast("double").alias("_s"), F.col(id_col).alias("_id")).distinct(), "_t").drop("_b")
    kept = suppressed(rows, keys, tolerance, inclusive=inclusive)
    return kept.select(*keys, F.col("_t").alias(time), F.col("_s").alias(score), F.col("_id").alias(id_col))


def best_spaced(events: DataFrame, keys: list[str], time: str, score: str, id_col: str, spacing: float, limit: str) -> DataFrame:
    """The ``limit`` best of the events that suppression with a strict spacing keeps (W13): as ``suppress``, with ``rank``.

    Taking the best k while suppressing equals suppressing all and taking the best k, as an
    event is only ever suppressed by better ones. ``limit`` is a column of the key.
    """
    kept = suppress(events, keys, time, score, id_col, spacing, inclusive=False)
    limits = events.groupBy(*keys).agg(F.max(limit).alias("_limit"))
    # Buckets of falling scores, those without a score last.
    kept = kept.withColumns({"_fall": -F.coalesce(score, F.lit(float("-inf"))), "_b": F.coalesce(F.floor(F.col(score) * -64).cast("long"), F.lit(1 << 62))})
    kept = with_row_number(kept, keys, "_b", ["_fall", time, id_col], "rank").drop("_b", "_fall")
    return kept.join(limits, keys).filter(F.col("rank") <= F.col("_limit")).drop("_limit")


def anchored_clusters(events: DataFrame, keys: list[str], time: str, id_col: str, tolerance: float, *, kind: str | None = None) -> DataFrame:
    """Add ``cluster``: the place of the event's cluster in its key's order of time.

    A cluster is anchored at its first event: the next one begins with the first event more than
    ``tolerance`` after the anchor or, with ``kind``, where the end of speech meets its start in one
    cluster. Events without a time are left out.
    """
    k = F.coalesce(F.when(F.col(kind) == "speech_start", 1).when(F.col(kind) == "speech_end", 2), F.lit(0)) if kind else F.lit(0)

    def following(t: np.ndarray, side: np.ndarray) -> np.ndarray:
        opposed = np.maximum(first_from(side == 1), first_from(side == 2))
        return np.minimum(first_beyond(t, tolerance), opposed)

    rows = chained(events.withColumn("_side", k), keys, time, id_col, ["_side"], tolerance, following).drop("_side", "segment")
    rows = with_bucket(rows.withColumn("_one", F.col("starts").cast("long")), time)
    return with_running_sum(rows, keys, "_b", [time, id_col], "_one", "cluster").drop("_one", "_b", "starts")


def moved_apart(rows: DataFrame, keys: list[str], time: str, number: str) -> DataFrame:
    """Times rounded to microseconds and, where taken, moved on by milliseconds to the next free one, in the order of ``number``.

    Times must not fall as ``number`` grows. Only times of the same microsecond within their
    millisecond can meet; of these the j-th ends at the greatest of the (time - j) so far, plus j.
    """
    us = F.round(F.col(time).cast("decimal(24,12)") * 1_000_000).cast("long")
    x = rows.withColumn("_us", us).withColumns({"_res": F.pmod("_us", F.lit(1000)), "_ms": F.floor(F.col("_us") / 1000).cast("long"), "_nb": F.floor(F.col(number) / 1000).cast("long")})
    per = [*keys, "_res"]
    x = with_row_number(x, per, "_nb", [number], "_j").withColumn("_lead", F.col("_ms") - F.col("_j"))
    x = with_running_max(x, per, "_nb", [number], "_lead", "_most")
    moved = (F.greatest("_lead", "_most") + F.col("_j")) * 1000 + F.col("_res")
    return x.withColumn(time, F.round((moved / 1_000_000).cast("decimal(24,12)"), 6).cast("double")).drop("_us", "_res", "_ms", "_nb", "_j", "_lead", "_most")


def fused_proposals(events: DataFrame, keys: list[str], tolerance: float, *, least: float = 0.60, keep_cluster: bool = False) -> DataFrame:
    """Clusters of signal events as proposals.

    Events have timestamp, kind, confidence, source_id. Result: keys, proposal_id, timestamp,
    confidence, primary_kind, evidence (count). The best weighted event gives time and
    kind; equal times of proposals are moved apart by a millisecond, also by those that are
    dropped later; confidences fuse by noisy-or. ``keep_cluster`` adds the cluster that a
    proposal is made of.
    """
    rows = anchored_clusters(events, keys, "timestamp", "source_id", tolerance, kind="kind")
    w = kind_weight("kind")
    part = F.least(F.lit(0.95), F.col("confidence") * F.least(F.lit(1.0), w))
    best = F.struct((F.col("confidence") * w).alias("w"), (-F.col("timestamp")).alias("t"))
    out = rows.groupBy(*keys, "cluster").agg(
        F.max_by(F.struct("timestamp", "kind"), best).alias("_best"),
        F.least(F.lit(0.99), 1 - F.exp(F.sum(F.log(1 - part)))).alias("_c"),
        F.count("*").alias("evidence"),
    )
    out = out.select(*keys, "cluster", F.col("_best.timestamp").alias("timestamp"), F.col("_best.kind").alias("primary_kind"), F.round(F.col("_c").cast("decimal(24,12)"), 4).cast("double").alias("confidence"), "evidence")
    out = cut_lineage(moved_apart(out, keys, "timestamp", "cluster").filter(F.col("confidence") >= least))
    out = with_row_number(with_bucket(out, "timestamp"), keys, "_b", ["timestamp"], "_number")
    return out.select(*keys, F.format_string("BP%04d", "_number").alias("proposal_id"), "timestamp", "confidence", "primary_kind", "evidence", *(["cluster"] if keep_cluster else []))


def adaptive_segments(samples: DataFrame, key: str, time: str, change: str, duration: str, *, shortest: float, longest: float, threshold: float) -> DataFrame:
    """Segments that tile [0, duration] (W16): key, segment_id, start, end, boundary_reason.

    A cut falls on a sample with ``change >= threshold`` at least ``shortest`` after the last cut, or
    on the first at least ``longest`` after it; the first sample never cuts; a cut that leaves less than
    ``shortest`` until the end is dropped. Null changes count as 0; rows with a null key, time or
    duration are left out; of samples of one time the greatest change counts.
    """
    rows = samples.select(F.col(key).alias("_k"), F.col(time).cast("double").alias("_t"), F.coalesce(F.col(change).cast("double"), F.lit(0.0)).alias("_c"), F.col(duration).cast("double").alias("_d")).filter("_k IS NOT NULL AND _d IS NOT NULL AND _t IS NOT NULL AND NOT isnan(_t)")
    rows = rows.groupBy("_k", "_t").agg(F.max("_c").alias("_c"), F.max("_d").alias("_d"))
    whole = cut_lineage(rows.groupBy("_k").agg(F.min("_t").alias("_first"), F.max("_d").alias("_d")))
    # Neither the first sample nor one at or before 0 or after the end can cut; the chain begins at 0.
    able = rows.drop("_d").join(whole, "_k").filter("_t > _first AND _t > 0 AND _t < _d").select("_k", "_t", "_c", "_d")
    rows = able.unionByName(whole.select("_k", F.lit(0.0).alias("_t"), F.lit(0.0).alias("_c"), "_d")).withColumn("_id", F.lit(0))

    def following(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        soon, late = first_beyond(t, shortest, inclusive=True), first_beyond(t, longest, inclusive=True)
        strong = np.append(first_from(c >= threshold), len(t))
        return np.minimum(strong[np.minimum(soon, len(t))], late)

    cuts = chained(rows, ["_k"], "_t", "_id", ["_c"], longest, following).filter("starts")
    cuts = cut_lineage(with_bucket(cuts.select("_k", "_t", "_c", "_d"), "_t").filter(~((F.col("_t") > 0) & (F.col("_d") - F.col("_t") < shortest))))
    cuts = with_row_number(with_next(cuts, ["_k"], "_b", ["_t"], ["_t"], "_n"), ["_k"], "_b", ["_t"], "_number")
    reason = F.when(F.col("_t") <= 0, "asset_start").when(F.col("_c") >= threshold, "visual_change").otherwise("max_duration")
    dec = lambda c: F.round(c.cast("decimal(24,12)"), 3).cast("double")
    return cuts.select(F.col("_k").alias(key), F.format_string("S%03d", "_number").alias("segment_id"), dec(F.col("_t")).alias("start"), dec(F.coalesce("_n._t", "_d")).alias("end"), reason.alias("boundary_reason"))


def accepted_speech(rows: DataFrame, key: str, order: str, start: str, end: str, norm: str, reasons: str, *, pause: float = 2.0) -> DataFrame:
    """Speech with the reasons against it (P1): all columns, and ``all_reasons``.

    ``reasons`` are those a row shows by itself. Duplicate phrase is added where its normalised
    text is that of the last *accepted* row and it starts at most ``pause`` after that row's end. A pause
    that long after every earlier end cuts the fold.
    """
    base = with_bucket(rows, start)
    base = cut_lineage(base.withColumn("_end", F.coalesce(F.col(end), F.col(start))))
    base = with_running_max(base, [key], "_b", [start, order], "_end", "_reach")
    base = base.withColumn("_cut", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > pause), F.col(order)))
    base = with_last_known(base, [key], "_b", [start, order], "_cut", "_island")
    ot = rows.schema[order].dataType.simpleString()
    init = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("end"), F.array().cast(f"array<{ot}>").alias("dups"))

    def step(acc: Column, x: Column) -> Column:
        dup = F.coalesce((x[norm] == acc["text"]) & (x[start] - acc["end"] <= pause), F.lit(False))
        good = (F.size(x[reasons]) == 0) & ~dup
        return F.struct(F.when(good, x[norm]).otherwise(acc["text"]).alias("text"), F.when(good, x["_end"]).otherwise(acc["end"]).alias("end"), F.when(dup, F.array_append(acc["dups"], x[order])).otherwise(acc["dups"]).alias("dups"))

    dups = ordered_fold(base, [key, "_island"], [F.col(start), F.col(order)], [start, "_end", norm, reasons, order], init, step, "_acc").select(key, F.explode("_acc.dups").alias(order)).withColumn("_dup", F.lit(True))
    out = rows.join(dups, [key, order], "left")
    return out.withColumn("all_reasons", F.when(F.col("_dup"), F.array_append(F.col(reasons), F.lit("duplicate_phrase"))).otherwise(F.col(reasons))).drop("_dup")


def merged_lines(rows: DataFrame, key: str, order: str, *, max_gap: float = 2.2, max_duration: float = 20.0, max_chars: int = 160) -> DataFrame:
    """Add ``line`` (order of its first utterance) to utterances with start, end, language, text.

    Neighbours join one line if they share a language other than uncertain or mixed, the gap is in
    [-0.05, max_gap], the line stays within ``max_duration`` from its first start and ``max_chars``,
    and no finished sentence is followed by a gap over 0.55. Rows without a start are left out.
    """
    base = with_bucket(rows, "start").withColumns({"_text": F.trim(F.regexp_replace("text", r"\s+", " ")), "_lang": F.lower(F.coalesce("language", F.lit("")))})
    base = base.withColumn("_done", F.col("_text").rlike(r"[.?!。？！]$"))

    def apart(p: Column) -> Column:
        gap = F.col("start") - p["end"]
        return (p["_lang"] != F.col("_lang")) | p["_lang"].isin("uncertain", "mixed", "") | (gap < -0.05) | (gap > max_gap) | (p["_done"] & (gap > 0.55))

    base = with_previous(base, [key], "_b", ["start", order], ["end", "_lang", "_done"], "_prev")
    base = base.select(key, order, "start", "end", F.length("_text").alias("_len"), (F.col("_prev").isNull() | F.coalesce(apart(F.col("_prev")), F.lit(False))).cast("int").alias("_apart"))

    def following(t: np.ndarray, end: np.ndarray, size: np.ndarray, cut: np.ndarray) -> np.ndarray:
        out = np.empty(len(t), dtype=np.int64)
        for i in range(len(t)):
            j, chars = i + 1, size[i]
            while j < len(t) and not cut[j] and not end[j] - t[i] > max_duration and not chars + size[j] + (j - i) > max_chars:
                chars += size[j]
                j += 1
            out[i] = j
        return out

    lines = cut_lineage(chained(base, [key], "start", order, ["end", "_len", "_apart"], max(max_duration, max_gap), following).select(key, order, "segment", "starts"))
    first = lines.filter("starts").select(key, "segment", F.col(order).alias("line"))
    return rows.join(lines.select(key, order, "segment").join(first, [key, "segment"]).drop("segment"), [key, order])
