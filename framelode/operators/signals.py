"""Signal events out of sampled series: thresholds, changes, stable runs, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_dec
from .ordered import with_bucket
from .sequence import with_last_known, with_next, with_previous, with_running_sum


def quantiles(df: DataFrame, key: str, value: str, q: float, *, floor: float = 0.0, name: str = "threshold") -> DataFrame:
    """key, threshold: the interpolated quantile of a key's values, at least ``floor`` (A6, A7); keys without values get the floor.

    Values are counted per key and value first, so that the exact quantile holds distinct values only.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    counted = df.select(key, v.alias("_v")).groupBy(key, "_v").agg(F.count("*").alias("_n"))
    return counted.groupBy(key).agg(F.greatest(F.lit(floor), F.coalesce(round_dec(F.percentile("_v", F.lit(q), F.col("_n")), 9), F.lit(0.0))).alias(name))


def percentile_ranks(df: DataFrame, key: str, value: str, name: str, *, eps: float = 0.001) -> DataFrame:
    """key, value, ``name``: the share of a key's values that aren't greater; a half where all are the same within ``eps``."""
    n = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col(value) * 1000).cast("long"))
    whole = n.groupBy(key).agg(F.sum("_n").alias("_all"), (F.max(value) - F.min(value)).alias("_width"))
    n = with_running_sum(n, [key], "_b", [value], "_n", "_upto").join(whole, key)
    return n.select(key, value, F.when(F.col("_width") <= eps, 0.5).otherwise(F.col("_upto") / F.col("_all")).alias(name))


def deltas(df: DataFrame, key: str, time: str, id_col: str, value: str, *, skip_first: bool = True) -> DataFrame:
    """Add ``delta``, the absolute change of ``value`` since the sample before.

    The first sample of a key is skipped as a predecessor too, as it is unreliable: pairs start with
    the second and third sample. Rows without a pair are left out.
    """
    rows = with_previous(with_bucket(df, time), [key], "_b", [time, id_col], [value], "_p")
    if skip_first:
        rows = with_previous(rows.withColumn("_first", F.col("_p").isNull()), [key], "_b", [time, id_col], ["_first"], "_pf").filter("NOT coalesce(_pf._first, true)")
        rows = rows.drop("_first", "_pf")
    return rows.withColumn("delta", F.abs(F.col(value) - F.col(f"_p.{value}"))).filter("delta IS NOT NULL").drop("_p", "_b")


def changes(df: DataFrame, key: str, time: str, id_col: str, cols: list[str]) -> DataFrame:
    """Add struct ``before`` with ``cols`` of the sample before; first samples are left out."""
    return with_previous(with_bucket(df, time), [key], "_b", [time, id_col], cols, "before").filter("before IS NOT NULL").drop("_b")


def vector_steps(df: DataFrame, key: str, order: str, vector: str, *, per_bucket: int = 1000) -> DataFrame:
    """Add ``distance``, the Euclidean distance to the vector before in a key (W2); the first has none."""
    rows = df.withColumn("_b", F.floor(F.col(order) / per_bucket).cast("long"))
    rows = with_previous(rows, [key], "_b", [order], [vector], "_p")
    square = F.zip_with(F.col(vector), F.col(f"_p.{vector}"), lambda a, b: (a - b).cast("double") * (a - b).cast("double"))
    return rows.withColumn("distance", F.when(F.col("_p").isNotNull(), F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x)))).drop("_p", "_b")


def gaps(df: DataFrame, key: str, start: str, end: str, *, least: float = 1.2) -> DataFrame:
    """Pauses of at least ``least`` between neighbouring intervals (W4): key, gap_start, gap_end, timestamp, confidence."""
    rows = with_next(with_bucket(df, start), [key], "_b", [start, end], [start], "_n")
    gap = F.col(f"_n.{start}") - F.col(end)
    rows = rows.withColumn("_g", gap).filter(F.col("_g") >= least)
    return rows.select(key, F.col(end).alias("gap_start"), F.col(f"_n.{start}").alias("gap_end"), round_dec((F.col(end) + F.col(f"_n.{start}")) / 2, 6).alias("timestamp"), round_dec(F.least(F.lit(0.92), 0.60 + F.col("_g") / 20), 4).alias("confidence"))


def stable_presence(df: DataFrame, key: str, time: str, id_col: str, count: str, *, least: int) -> DataFrame:
    """Changes of presence between neighbouring runs of at least ``least`` samples.

    Result: key, timestamp (first of the new run), id, present, samples. Shorter runs are
    overlooked, so a change counts against the last long run.
    """
    here = (F.coalesce(F.col(count), F.lit(0)) > 0).cast("int")
    order = [time, id_col]
    rows = with_bucket(df.select(key, time, id_col, here.alias("_on")), time)
    rows = with_previous(rows, [key], "_b", order, ["_on"], "_p")
    head = F.col("_p").isNull() | (F.col("_p._on") != F.col("_on"))
    rows = with_last_known(rows.withColumn("_h", F.when(head, F.struct(*order))), [key], "_b", order, "_h", "_run")
    runs = rows.groupBy(key, "_run").agg(F.max("_on").alias("_on"), F.count("*").alias("samples")).filter(F.col("samples") >= least)
    runs = runs.select(key, F.col(f"_run.{time}").alias(time), F.col(f"_run.{id_col}").alias(id_col), "_on", "samples")
    runs = with_previous(with_bucket(runs, time), [key], "_b", order, ["_on"], "_p")
    return runs.filter("_p IS NOT NULL AND _p._on <> _on").select(key, F.col(time).alias("timestamp"), F.col(id_col).alias("id"), (F.col("_on") == 1).alias("present"), "samples")


def persistent_words(df: DataFrame, key: str, time: str, words: str, *, below: float = 0.35) -> DataFrame:
    """Changes of the words that last from one sample to the next (W6): key, timestamp, similarity.

    A sample's lasting words are those it shares with the following one; they are compared with the
    lasting words of the sample before by Jaccard similarity. ``df`` has one row per key and time.
    """
    rows = with_next(with_bucket(df.select(key, time, words), time), [key], "_b", [time], [words], "_n").filter("_n IS NOT NULL")
    rows = rows.withColumn("_last", F.array_intersect(F.col(words), F.col(f"_n.{words}")))
    rows = with_previous(rows, [key], "_b", [time], ["_last"], "_p").filter("_p IS NOT NULL")
    union = F.size(F.array_union("_last", F.col("_p._last")))
    same = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("_last", F.col("_p._last"))) / union)
    return rows.withColumn("similarity", same).filter((F.col("similarity") < below) & (union > 0)).select(key, F.col(time).alias("timestamp"), round_dec("similarity", 4).alias("similarity"))


def percentile_rank(df: DataFrame, key: str, value: str, name: str = "rank") -> DataFrame:
    """Add ``name``: the share of a key's values at most this one; 0.5 if they are all the same, null for null."""
    return df.join(percentile_ranks(df, key, value, name), [key, value], "left")


def representatives(spans: DataFrame, samples: DataFrame, key: str, span_id: str, span: tuple[str, str], time: str, id_col: str, quality: str) -> DataFrame:
    """key, span id, time, id, ``inside``: the sample that shows each span best.

    Of the samples from its start up to before its end the one of greatest quality (null is 0) less 0.12 times its distance
    from the middle in span lengths; where there is none, the nearest to the middle. Ties go to the earlier
    sample, then the smaller id. Keys without samples have none.
    """
    from .intervals import nearest, points_in

    a, b = map(F.col, span)
    some = spans.select(key, span_id, *span)
    points = samples.select(key, F.col(time).alias("_pt"), F.col(id_col).alias("_pi"), F.col(quality).alias("_pq"))
    p = points_in(points, some, key, "_pt", span).filter(F.col("_pt") < b)
    score = round_dec(F.coalesce("_pq", F.lit(0.0)) - 0.12 * F.abs(F.col("_pt") - (a + b) / 2) / F.greatest(F.lit(1.0), b - a), 9)
    best = p.groupBy(key, span_id).agg(F.min_by(F.struct("_pt", "_pi"), F.struct((-score).alias("n"), "_pt", "_pi")).alias("_x"))
    inside = best.select(key, span_id, F.col("_x._pt").alias(time), F.col("_x._pi").alias(id_col), F.lit(True).alias("inside"))
    rest = some.join(best, [key, span_id], "left_anti").withColumn("_mid", (a + b) / 2)
    out = nearest(rest, points, key, "_mid", "_pt", ["_pi"]).filter("_pt IS NOT NULL")
    return inside.unionByName(out.select(key, span_id, F.col("_pt").alias(time), F.col("_pi").alias(id_col), F.lit(False).alias("inside")))


def event(kind: str, time: Column, confidence: Column, source: Column) -> list[Column]:
    """The columns of a signal event."""
    return [round_dec(time, 6).alias("timestamp"), F.lit(kind).alias("kind"), round_dec(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 4).alias("confidence"), source.alias("source_id")]
