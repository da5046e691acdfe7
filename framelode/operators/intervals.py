"""Interval algebra on a time axis, always within a key.

Overlap joins carry a time bucket beside the key, so that the rows of one key spread over
many tasks and only neighbours in time meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import with_last_known, with_next, with_previous, with_running_max

BUCKET_S = 60.0


def spread(df: DataFrame, start: str, end: str, name: str, width: float = BUCKET_S) -> DataFrame:
    """One row for each bucket an interval touches; rows without both bounds, or with the end before the start, are left out."""
    ok = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    return ok.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], *, how: str = "inner", least: float = 0.0, width: float = BUCKET_S) -> DataFrame:
    """Rows of ``a`` and ``b`` of one key whose half-open intervals overlap by more than ``least`` (J1); touching ones don't.

    Besides ``key`` the column names must differ. Of the buckets both touch only the first makes the
    pair, so no pair is made twice and none has to be removed. ``how`` may be inner, left_semi or left_anti.
    """
    (a1, a2), (b1, b2) = a_span, b_span
    if how == "inner":
        x, y = spread(a, a1, a2, "_bk", width), spread(b, b1, b2, "_bk", width)
        first = F.floor(F.greatest(F.col(a1), F.col(b1)) / width).cast("long") == F.col("_bk")
        hit = (F.col(a1) < F.col(b2)) & (F.col(a2) > F.col(b1)) & first
        if least:
            hit = hit & (F.least(F.col(a2), F.col(b2)) - F.greatest(F.col(a1), F.col(b1)) > least)
        return x.join(y, [key, "_bk"]).filter(hit).drop("_bk")
    tagged = a.withColumn("_row", F.monotonically_increasing_id())
    ids = [c for c in a.columns]
    pairs = overlap_join(a.select(*ids), b.select(key, b1, b2), key, a_span, b_span, least=least, width=width).select(*ids).distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ids]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return tagged.drop("_row").alias("l").join(pairs.alias("r"), cond, how)


def clipped(df: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], start: str, end: str) -> DataFrame:
    """Add the shared interval of two overlapping ones."""
    return df.withColumns({start: F.greatest(*map(F.col, (a_span[0], b_span[0]))), end: F.least(*map(F.col, (a_span[1], b_span[1])))})


def best_overlap(a: DataFrame, groups: DataFrame, key: str, a_id: str, a_span: tuple[str, str], group_id: str, g_span: tuple[str, str]) -> DataFrame:
    """Each interval with the one group it shares most time with; ties go to the earliest group.

    Adds ``group_id`` and ``shared``; intervals without any overlap have null there.
    """
    pairs = overlap_join(a.select(key, a_id, *a_span), groups.select(key, group_id, *g_span), key, a_span, g_span)
    shared = F.least(F.col(a_span[1]), F.col(g_span[1])) - F.greatest(F.col(a_span[0]), F.col(g_span[0]))
    top = pairs.groupBy(key, a_id).agg(F.max_by(F.struct(group_id, shared.alias("shared")), F.struct(F.round(shared.cast("decimal(24,12)"), 6), -F.col(g_span[0]), -F.col(g_span[1]))).alias("_x"))
    return a.join(top.select(key, a_id, F.col(f"_x.{group_id}").alias(group_id), F.col("_x.shared").alias("shared")), [key, a_id], "left")


def points_in(points: DataFrame, spans: DataFrame, key: str, time: str, span: tuple[str, str], *, width: float = BUCKET_S) -> DataFrame:
    """Points with the half-open intervals that hold them; a key's last interval is closed on the right."""
    ends = spans.groupBy(key).agg(F.max(span[1]).alias("_final"))
    s = spread(spans.join(ends, key), span[0], span[1], "_bk", width)
    p = points.filter(F.col(time).isNotNull()).withColumn("_bk", F.floor(F.col(time) / width).cast("long"))
    inside = (F.col(time) >= F.col(span[0])) & ((F.col(time) < F.col(span[1])) | ((F.col(span[1]) == F.col("_final")) & (F.col(time) == F.col(span[1]))))
    return p.join(s, [key, "_bk"]).filter(inside).drop("_bk", "_final")


def near_semi(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str, within: float, *, other: Column | None = None) -> DataFrame:
    """Rows of ``a`` for which ``b`` has a row of the key at most ``within`` away (J12); ``other`` may ask for more.

    ``b``'s columns must have other names than ``a``'s except the key. A row of ``b`` is put into the
    buckets within reach of it, ``a`` into its own.
    """
    width = max(within * 4, 1e-6)
    y = b.filter(F.col(b_time).isNotNull()).withColumn("_bk", F.explode(F.sequence(F.floor((F.col(b_time) - within) / width).cast("long"), F.floor((F.col(b_time) + within) / width).cast("long"))))
    x = a.filter(F.col(a_time).isNotNull()).withColumn("_bk", F.floor(F.col(a_time) / width).cast("long"))
    cond = (x[key] == y[key]) & (x["_bk"] == y["_bk"]) & (F.abs(x[a_time] - y[b_time]) <= within)
    return x.join(y, cond & other if other is not None else cond, "left_semi").drop("_bk")


def nearest(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str, b_cols: list[str]) -> DataFrame:
    """Each row of ``a`` with the row of ``b`` nearest in time, whatever the distance; the earlier wins ties.

    Both sides go into one sequence per key; the last and the next row of ``b`` are looked up from
    there, so no pairs are formed. Ties on time in ``b`` go to the smallest ``b_cols``.
    """
    right = b.filter(F.col(b_time).isNotNull()).groupBy(key, F.col(b_time)).agg(F.min(F.struct(*b_cols)).alias("_m")).select(key, F.col(b_time).alias("_t"), F.struct(F.col(b_time).alias("t"), *(F.col(f"_m.{c}").alias(c) for c in b_cols)).alias("_hit"))
    left = a.filter(F.col(a_time).isNotNull()).select(key, F.col(a_time).alias("_t"), F.struct(*a.columns).alias("_row"))
    both = left.withColumn("_hit", F.lit(None).cast(right.schema["_hit"].dataType)).unionByName(right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)))
    both = both.withColumns({"_b": F.floor(F.col("_t") / 600.0).cast("long"), "_side": F.col("_row").isNotNull().cast("int")})
    both = with_last_known(both, [key], "_b", ["_t", "_side"], "_hit", "_back")
    both = both.withColumns({"_nt": -F.col("_t"), "_nb": -F.col("_b")})
    both = with_last_known(both, [key], "_nb", ["_nt", "_side"], "_hit", "_ahead").filter("_side = 1")
    db, da = F.col("_t") - F.col("_back.t"), F.col("_ahead.t") - F.col("_t")
    pick = F.when(F.col("_ahead").isNull() | (db <= da), F.col("_back")).otherwise(F.col("_ahead"))
    out = both.withColumn("_pick", F.when(F.col("_back").isNull(), F.col("_ahead")).otherwise(pick))
    return out.select("_row.*", F.col("_pick.t").alias(b_time), *(F.col(f"_pick.{c}").alias(c) for c in b_cols))


def merged(df: DataFrame, keys: list[str], start: str, end: str, *, gap: float = 0.0) -> DataFrame:
    """Unions of intervals; a new one begins where a start exceeds all earlier ends by more than ``gap``.

    Result: keys, start, end. Rows without both bounds or with the end not after the start are left out.
    """
    rows = df.filter(F.col(end) > F.col(start)).groupBy(*keys, start).agg(F.max(end).alias(end)).withColumn("_b", F.floor(F.col(start) / 600.0).cast("long"))
    rows = with_running_max(rows, keys, "_b", [start], end, "_reach")
    rows = rows.withColumn("_head", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), F.col(start)))
    rows = with_last_known(rows, keys, "_b", [start], "_head", "_island")
    return rows.groupBy(*keys, "_island").agg(F.max(end).alias(end)).select(*keys, F.col("_island").alias(start), end)


def complement(spans: DataFrame, whole: DataFrame, key: str, start: str, end: str, duration: str) -> DataFrame:
    """What intervals leave free of [0, duration], head and tail included (W9): key, start, end."""
    d = whole.select(key, F.col(duration).alias("_d")).filter("_d > 0").dropDuplicates([key])
    cut = spans.join(d, key).select(key, F.greatest(F.lit(0.0), F.least(F.col(start), F.col("_d"))).alias(start), F.greatest(F.lit(0.0), F.least(F.col(end), F.col("_d"))).alias(end))
    solid = merged(cut, [key], start, end).withColumn("_b", F.floor(F.col(start) / 600.0).cast("long"))
    solid = with_previous(solid, [key], "_b", [start], [end], "_prev")
    before = solid.select(key, F.coalesce(F.col(f"_prev.{end}"), F.lit(0.0)).alias(start), F.col(start).alias(end))
    last = d.join(solid.groupBy(key).agg(F.max(end).alias("_m")), key, "left").select(key, F.coalesce("_m", F.lit(0.0)).alias(start), F.col("_d").alias(end))
    return before.unionByName(last).filter(F.col(end) > F.col(start))


def split_evenly(df: DataFrame, start: str, end: str, longest: float) -> DataFrame:
    """Intervals cut into equal pieces of at most ``longest`` (W10); adds ``piece`` and ``pieces``."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / longest)).cast("int")
    rows = df.withColumn("pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    step = (F.col(end) - F.col(start)) / F.col("pieces")
    return rows.withColumns({start: F.col(start) + F.col("piece") * step, end: F.when(F.col("piece") == F.col("pieces") - 1, F.col(end)).otherwise(F.col(start) + (F.col("piece") + 1) * step)})


def shared_seconds(a: DataFrame, b: DataFrame, key: str, a_id: str, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Seconds of each interval that the others cover, at most its own length (A18): key, id, shared, share."""
    pairs = overlap_join(a.select(key, a_id, *a_span), b.select(key, *b_span), key, a_span, b_span)
    part = (F.least(F.col(a_span[1]), F.col(b_span[1])) - F.greatest(F.col(a_span[0]), F.col(b_span[0]))).cast("decimal(24,9)")
    sums = pairs.groupBy(key, a_id).agg(F.sum(part).cast("double").alias("_s"))
    length = F.col(a_span[1]) - F.col(a_span[0])
    out = a.select(key, a_id, *a_span).join(sums, [key, a_id], "left").withColumn("shared", F.least(length, F.coalesce("_s", F.lit(0.0))))
    return out.select(key, a_id, "shared", F.when(length > 0, F.col("shared") / length).alias("share"))


def uncovered(spans: DataFrame, fragments: DataFrame, keys: list[str], start: str, end: str, *, tolerance: float = 0.002) -> DataFrame:
    """Intervals that their fragments don't cover without a hole beyond ``tolerance`` (M3): keys, largest hole.

    ``spans`` has one interval per keys, ``fragments`` any number with the same keys and bound names.
    """
    s = spans.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    f = fragments.join(s, keys).select(*keys, F.greatest(start, "_s").alias("_fs"), F.least(end, "_e").alias("_fe"), "_s", "_e").filter("_fe > _fs")
    w = Window.partitionBy(*keys).orderBy("_fs", "_fe").rowsBetween(Window.unboundedPreceding, -1)
    holes = f.withColumn("_h", F.col("_fs") - F.coalesce(F.max("_fe").over(w), F.col("_s"))).groupBy(*keys).agg(F.max("_h").alias("_h"), F.max("_fe").alias("_m"))
    out = s.join(holes, keys, "left").withColumn("hole", F.greatest(F.coalesce("_h", F.col("_e") - F.col("_s")), F.col("_e") - F.coalesce("_m", F.col("_s"))))
    return out.filter(F.col("hole") > tolerance).select(*keys, "hole")


def neighbours(a: DataFrame, b: DataFrame, key: str, a_id: str, a_span: tuple[str, str], b_id: str, b_span: tuple[str, str], *, slack: float = 0.001) -> DataFrame:
    """For each interval the last of the others that ends by its start and the first that starts by its end.

    Adds ``previous_id`` and ``next_id``, null where there is none. Looked up in one sequence per key.
    """
    ends = b.select(key, F.col(b_span[1]).alias("_t"), F.struct(F.col(b_span[1]).alias("t"), F.col(b_id).alias("id")).alias("_hit"))
    starts = b.select(key, (-F.col(b_span[0])).alias("_t"), F.struct((-F.col(b_span[0])).alias("t"), F.col(b_id).alias("id")).alias("_hit"))

    def look(side: DataFrame, at: Column, name: str) -> DataFrame:
        hits = side.filter("_t IS NOT NULL").groupBy(key, "_t").agg(F.min("_hit").alias("_hit")).withColumns({"_id": F.lit(None).cast(a.schema[a_id].dataType), "_side": F.lit(0)})
        asks = a.select(key, at.alias("_t"), F.lit(None).cast(hits.schema["_hit"].dataType).alias("_hit"), F.col(a_id).alias("_id"), F.lit(1).alias("_side")).filter("_t IS NOT NULL")
        both = hits.unionByName(asks).withColumn("_b", F.floor(F.col("_t") / 600.0).cast("long"))
        both = with_last_known(both, [key], "_b", ["_t", "_side", "_id"], "_hit", "_found")
        return both.filter("_side = 1").select(key, F.col("_id").alias(a_id), F.col("_found.id").alias(name))

    before = look(ends, F.col(a_span[0]) + slack, "previous_id")
    after = look(starts, -(F.col(a_span[1]) - slack), "next_id")
    return a.join(before, [key, a_id], "left").join(after, [key, a_id], "left")


def context_ids(a: DataFrame, b: DataFrame, key: str, a_id: str, a_span: tuple[str, str], b_id: str, b_span: tuple[str, str], *, around: int = 2) -> DataFrame:
    """Ids of the others that overlap an interval and of up to ``around`` before and after it.

    Adds arrays ``previous_ids``, ``overlapping_ids``, ``next_ids``, each in order of time.
    """
    rows = b.select(key, F.col(b_id).alias("_id"), F.col(b_span[0]).alias("_s"), F.col(b_span[1]).alias("_e")).filter("_e >= _s")
    rows = rows.withColumn("_b", F.floor(F.col("_e") / 600.0).cast("long"))
    # Each interval carries the ends up to it: the ``around`` last ones, by walking back that many times.
    back = rows.withColumn("_prev_1", F.struct(F.col("_e").alias("t"), F.col("_id").alias("id")))
    for i in range(1, around):
        back = with_previous(back, [key], "_b", ["_e", "_id"], [f"_prev_{i}"], "_p").withColumn(f"_prev_{i + 1}", F.col(f"_p._prev_{i}")).drop("_p")
    hits = back.groupBy(key, "_e").agg(F.max_by(F.array(*(F.col(f"_prev_{i}.id") for i in range(1, around + 1))), "_id").alias("_h")).select(key, F.col("_e").alias("_t"), "_h")
    rows = rows.withColumns({"_ns": -F.col("_s"), "_nb": -F.floor(F.col("_s") / 600.0).cast("long")})
    ahead = rows.withColumn("_next_1", F.struct(F.col("_s").alias("t"), F.col("_id").alias("id")))
    for i in range(1, around):
        ahead = with_previous(ahead, [key], "_nb", ["_ns", "_id"], [f"_next_{i}"], "_p").withColumn(f"_next_{i + 1}", F.col(f"_p._next_{i}")).drop("_p")
    later = ahead.groupBy(key, "_ns").agg(F.max_by(F.array(*(F.col(f"_next_{i}.id") for i in range(1, around + 1))), "_id").alias("_h")).select(key, F.col("_ns").alias("_t"), "_h")

    def look(side: DataFrame, at: Column, name: str, flip: bool) -> DataFrame:
        hits_ = side.withColumns({"_ask": F.lit(None).cast(a.schema[a_id].dataType), "_side": F.lit(0)})
        asks = a.select(key, at.alias("_t"), F.lit(None).cast(hits_.schema["_h"].dataType).alias("_h"), F.col(a_id).alias("_ask"), F.lit(1).alias("_side"))
        both = hits_.unionByName(asks).withColumn("_b", F.floor(F.col("_t") / 600.0).cast("long"))
        both = with_last_known(both, [key], "_b", ["_t", "_side", "_ask"], "_h", "_found").filter("_side = 1")
        got = F.coalesce(F.array_compact("_found"), F.array().cast(hits_.schema["_h"].dataType))
        return both.select(key, F.col("_ask").alias(a_id), (F.reverse(got) if flip else got).alias(name))

    over = overlap_join(a.select(key, a_id, *a_span), b.select(key, b_id, *b_span), key, a_span, b_span)
    over = over.groupBy(key, a_id).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(b_span[0]).alias("t"), F.col(b_id).alias("id")))), lambda x: x["id"]).alias("overlapping_ids"))
    out = a.select(key, a_id).join(look(hits, F.col(a_span[0]), "previous_ids", True), [key, a_id], "left").join(look(later, -F.col(a_span[1]), "next_ids", False), [key, a_id], "left")
    out = out.join(over, [key, a_id], "left")
    return out.withColumn("overlapping_ids", F.coalesce("overlapping_ids", F.array().cast(over.schema["overlapping_ids"].dataType)))


__all__ = ["best_overlap", "clipped", "complement", "context_ids", "merged", "near_semi", "nearest", "neighbours", "overlap_join", "points_in", "shared_seconds", "split_evenly", "spread", "uncovered", "with_next"]
