"""Constraints as tables of violations: check, asset_id, entity_id, message. A constraint holds iff its table is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_bucket
from .sequence import with_previous


def violations(df: DataFrame, check: str, asset: str, entity: str, broken: Column, message: Column | str) -> DataFrame:
    """Rows for which ``broken`` is true; null counts as not broken."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.coalesce(broken, F.lit(False))).select(F.lit(check).alias("check"), F.col(asset).cast("string").alias("asset_id"), F.col(entity).cast("string").alias("entity_id"), text.alias("message"))


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def missing(df: DataFrame, other: DataFrame, on: str, check: str, asset: str, message: str) -> DataFrame:
    """Rows whose ``on`` doesn't occur in the other table; nulls refer to nothing and aren't missing."""
    gone = df.filter(F.col(on).isNotNull()).join(other.select(on).distinct(), on, "left_anti")
    return violations(gone, check, asset, on, F.lit(True), message)


def duplicates(df: DataFrame, asset: str, entity: str, check: str) -> DataFrame:
    """Ids that occur more than once."""
    n = df.groupBy(asset, entity).agg(F.count("*").alias("_n"))
    return violations(n, check, asset, entity, F.col("_n") > 1, "id isn't unique")


def tiling(df: DataFrame, whole: DataFrame, asset: str, entity: str, start: str, end: str, duration: str, check: str, *, tolerance: float = 0.002) -> DataFrame:
    """Intervals must start at zero, follow each other without gap or overlap, and reach the duration (V1)."""
    rows = with_previous(with_bucket(df, start), [asset], "_b", [start, entity], [end], "_p")
    first = violations(rows, check, asset, entity, F.col("_p").isNull() & (F.abs(start) > tolerance), "doesn't start at zero")
    holes = violations(rows, check, asset, entity, F.abs(F.col(start) - F.col(f"_p.{end}")) > tolerance, "gap or overlap before it")
    empty = violations(rows, check, asset, entity, F.col(end) <= F.col(start), "no length")
    last = df.groupBy(asset).agg(F.max(end).alias("_m")).join(whole.select(asset, duration), asset).withColumn("_id", F.lit("end"))
    short = violations(last, check, asset, "_id", F.abs(F.col("_m") - F.col(duration)) > tolerance, "doesn't reach the end")
    return all_of(first, holes, empty, short)


def proposals(df: DataFrame, evidence: DataFrame, whole: DataFrame, asset: str, entity: str, number: str, cluster: str, duration: str, check: str, *, tolerance: float, eps: float = 0.001) -> DataFrame:
    """Proposals (timestamp, confidence, primary_kind) against their evidence (V9).

    Ids are unique, times lie in the media and increase with ``number``, confidences lie in 0
    to 1; each proposal has evidence of the same ``cluster``, with other source ids, none of it
    further than ``tolerance`` from its time or outside the media, and some of its primary kind.
    """
    late = lambda c: (F.col(c) < 0) | (F.col(c) > F.col(duration) + eps)
    rows = df.join(whole.select(asset, duration).distinct(), asset, "left").withColumn("_b", F.floor(F.col(number) / 1000).cast("long"))
    rows = with_previous(rows, [asset], "_b", [number, entity], ["timestamp"], "_p")
    found = evidence.select(asset, cluster, F.col("timestamp").alias("_et"), F.col("kind").alias("_ek"), F.col("source_id").alias("_es"), F.col("confidence").alias("_ec"))
    of = rows.select(asset, entity, cluster, "timestamp", "primary_kind", duration).join(found, [asset, cluster], "left").groupBy(asset, entity).agg(
        F.count("_es").alias("_n"), F.countDistinct("_es").alias("_ids"), F.max(F.abs(F.col("_et") - F.col("timestamp"))).alias("_far"),
        F.max(F.coalesce(F.col("_ek") == F.col("primary_kind"), F.lit(False))).alias("_has"), F.max(late("_et")).alias("_out"), F.min(F.col("_ec").between(0, 1)).alias("_sure"),
    )
    at = lambda d, broken, message: violations(d, check, asset, entity, broken, message)
    return all_of(
        duplicates(df, asset, entity, check),
        at(rows, F.col("timestamp").isNull() | late("timestamp"), "outside the media"),
        at(rows, F.col("timestamp") <= F.col("_p.timestamp") + eps, "time doesn't increase"),
        at(rows, ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0 to 1"),
        at(of, F.col("_n") == 0, "no evidence"),
        at(of, F.col("_ids") < F.col("_n"), "evidence named twice"),
        at(of, F.col("_far") > tolerance + eps, "evidence beyond the tolerance"),
        at(of, F.col("_out"), "evidence outside the media"),
        at(of, ~F.col("_sure"), "confidence of evidence outside 0 to 1"),
        at(of, (F.col("_n") > 0) & ~F.col("_has"), "primary kind absent from the evidence"),
    )
