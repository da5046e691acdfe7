"""Continuous periods and gaps of overlapping intervals (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import with_running_max

BUCKET_MS = 600_000


def to_ms(seconds) -> F.Column:
    """Seconds to whole milliseconds; null and NaN give null."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(~F.isnan(c), F.round(c * 1000)).cast("long")


def covered_periods(df: DataFrame, keys: list[str], start: str, end: str, *, bucket: int = BUCKET_MS) -> DataFrame:
    """Merge the intervals of each key into periods and list the gaps between them.

    ``start`` and ``end`` are long columns in one unit; touching intervals continue each other.
    Result: keys, kind ('period' or 'gap'), start, end. Columns of the input with the same
    names as internal ones don't matter, only keys and bounds are read.

    Cases: rows with a null key or bound, or with ``end <= start``, are left out; an empty
    table gives an empty result; repeated rows and ties on ``start`` count once.

    Each start is compared with the running maximum of earlier ends. Rows of one start are
    reduced to their greatest end first (map-side), and the running maximum is carried over
    buckets of ``bucket`` units, so no task holds a whole hot key.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), F.col(start).alias("_s"), F.col(end).alias("_e"))
    for c in [*ks, "_s", "_e"]:
        base = base.filter(F.col(c).isNotNull())
    base = base.filter("_e > _s").groupBy(*ks, "_s").agg(F.max("_e").alias("_e"))
    base = base.withColumn("_b", F.floor(F.col("_s") / F.lit(bucket)).cast("long"))
    seen = with_running_max(base, ks, "_b", ["_s"], "_e", "_before")
    heads = seen.filter("_before IS NULL OR _s > _before").select(*ks, "_b", "_s", "_before")
    # A period ends where the next head found its running maximum; the last one ends at the key's greatest end.
    inner = heads.withColumn("_next", F.lead("_before").over(Window.partitionBy(*ks, "_b").orderBy("_s")))
    firsts = heads.groupBy(*ks, "_b").agg(F.min_by("_before", "_s").alias("_first"))
    carry = firsts.select(*ks, "_b", F.lead("_first").over(Window.partitionBy(*ks).orderBy("_b")).alias("_later"))
    tops = base.groupBy(*ks).agg(F.max("_e").alias("_top"))
    whole = inner.join(carry, [*ks, "_b"], "left").join(tops, ks, "left")
    rows = whole.select(
        *ks,
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("_s").alias("s"), F.coalesce("_next", "_later", "_top").alias("e")),
                    F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("s"), F.col("_s").alias("e")),
                ),
                lambda x: x["s"].isNotNull(),
            )
        ).alias("_x"),
    )
    return rows.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), F.col("_x.kind").alias("kind"), F.col("_x.s").alias(start), F.col("_x.e").alias(end))
