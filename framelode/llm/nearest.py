"""Matching records by nearest time with tick expansion (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ticks are whole microseconds. Those that left records occupy are gathered in cells of so many tolerances.
TICKS_PER_SECOND, TOLERANCES_PER_CELL = 1_000_000, 5


def _tick(c) -> F.Column:
    return F.when(~F.isnan(c), F.round(F.col(c) * TICKS_PER_SECOND)).cast("long")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, left_cols: list[str], right_time: str, right_id: str, tolerance: float, *, cell: int = TOLERANCES_PER_CELL) -> DataFrame:
    """Pair every left row with the right row of the same key nearest in time, within ``tolerance`` seconds inclusive.

    Result: ``left_cols`` and ``right_id``, one row per distinct left row that has a partner.

    Each right row is exploded to the discrete ticks within tolerance of it; of each key's tick
    the nearest right row is kept, and left rows join on (key, tick) by equality. Ticks that no left
    row occupies could never join, so they aren't made: the distinct ticks asked for are gathered
    per key and cell of ``cell`` tolerances, whose number of ticks bounds the set, and a right row is
    exploded to those of its own cell and of a neighbouring one within reach.

    Cases: rows with a null key, time or NaN time have no partner and are left out; empty tables
    give an empty result; repeated rows count once; of equally near partners the earlier, then
    the smaller id wins. Right rows of one instant are reduced to their smallest id before they
    are exploded, so a hot instant can't gather in one tick.
    """
    tol = round(tolerance * TICKS_PER_SECOND)
    width = max(1, tol * cell)
    ks = [f"_k{i}" for i in range(len(keys))]
    named = lambda df: [F.col(k).alias(a) for k, a in zip(keys, ks)]
    at = lambda c: F.floor(c / F.lit(width)).cast("long")
    lc = [f"_l{i}" for i in range(len(left_cols))]
    lf = left.select(*named(left), _tick(left_time).alias("_tick"), *(F.col(c).alias(a) for c, a in zip(left_cols, lc)))
    r = right.select(*named(right), _tick(right_time).alias("_t"), F.col(right_id).alias("_id"))
    for c in ks:
        lf, r = lf.filter(F.col(c).isNotNull()), r.filter(F.col(c).isNotNull())
    lf = lf.filter("_tick IS NOT NULL").repartition(*ks, "_tick").dropDuplicates([*ks, "_tick", *lc])
    asked = lf.groupBy(*ks, "_tick").agg(F.lit(1).alias("_one")).groupBy(*ks, at(F.col("_tick")).alias("_cell")).agg(F.collect_list("_tick").alias("_ticks"))
    r = r.filter("_t IS NOT NULL").groupBy(*ks, "_t").agg(F.min("_id").alias("_id"))
    r = r.withColumn("_cell", F.explode(F.sequence(at(F.col("_t") - tol), at(F.col("_t") + tol))))
    reach = F.filter("_ticks", lambda x: F.abs(x - F.col("_t")) <= tol)
    copies = r.join(asked, [*ks, "_cell"]).select(*ks, "_t", "_id", F.explode(reach).alias("_tick"))
    best = copies.groupBy(*ks, "_tick").agg(F.min(F.struct(F.abs(F.col("_t") - F.col("_tick")), "_t", "_id")).alias("_best"))
    return lf.join(best, [*ks, "_tick"]).select(*(F.col(a).alias(c) for c, a in zip(left_cols, lc)), F.col("_best._id").alias(right_id))
