"""Distributed look-back over ordered sequences.

A plain window puts a whole key into one task. Here a key is cut into buckets of
its order axis; rows look back inside their bucket, and one summary row per
bucket carries what earlier buckets leave behind. Only the summaries of a key
ever meet in one task, so a key that holds a third of all rows still spreads
over many tasks. Rows whose key or bucket is null belong to no sequence and must
be removed by the caller (equi-joins on the summaries drop nothing else).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_previous(df: DataFrame, keys: list[str], bucket: str, order: list[str], cols: list[str], name: str) -> DataFrame:
    """Add struct ``name`` with ``cols`` of the row before in the key's order, null for the first row.

    ``order`` must be a total order that starts with an axis on which ``bucket`` is monotone.
    """
    here = F.struct(*cols)
    per = [*keys, bucket]
    inner = df.withColumn(name, F.lag(here).over(_window(per, order)))
    ends = df.groupBy(*per).agg(F.max_by(here, F.struct(*order)).alias("_end"))
    carry = ends.select(*per, F.lag("_end").over(_window(keys, [bucket])).alias("_carry"))
    return inner.join(carry, per, "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def with_next(df: DataFrame, keys: list[str], bucket: str, order: list[str], cols: list[str], name: str) -> DataFrame:
    """Add struct ``name`` with ``cols`` of the row after in the key's order, null for the last row."""
    here = F.struct(*cols)
    per = [*keys, bucket]
    inner = df.withColumn(name, F.lead(here).over(_window(per, order)))
    heads = df.groupBy(*per).agg(F.min_by(here, F.struct(*order)).alias("_head"))
    carry = heads.select(*per, F.lead("_head").over(_window(keys, [bucket])).alias("_carry"))
    return inner.join(carry, per, "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def with_last_known(df: DataFrame, keys: list[str], bucket: str, order: list[str], col: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``col`` at or before the row in the key's order."""
    per = [*keys, bucket]
    inner = df.withColumn(name, F.last(col, ignorenulls=True).over(_window(per, order).rowsBetween(Window.unboundedPreceding, 0)))
    known = F.col(col).isNotNull()
    ends = df.groupBy(*per).agg(F.max_by(F.when(known, F.col(col)), F.when(known, F.struct(*order))).alias("_end"))
    carry = ends.select(*per, F.last("_end", ignorenulls=True).over(_window(keys, [bucket]).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return inner.join(carry, per, "left").withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def with_running_max(df: DataFrame, keys: list[str], bucket: str, order: list[str], col: str, name: str) -> DataFrame:
    """Add ``name``: the maximum of ``col`` over all rows strictly before in the key's order, null for the first."""
    per = [*keys, bucket]
    inner = df.withColumn(name, F.max(col).over(_window(per, order).rowsBetween(Window.unboundedPreceding, -1)))
    tops = df.groupBy(*per).agg(F.max(col).alias("_top"))
    carry = tops.select(*per, F.max("_top").over(_window(keys, [bucket]).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return inner.join(carry, per, "left").withColumn(name, F.greatest(name, "_carry")).drop("_carry")


def with_running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], col: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``col`` up to and with the row in the key's order."""
    per = [*keys, bucket]
    inner = df.withColumn(name, F.sum(col).over(_window(per, order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = df.groupBy(*per).agg(F.sum(col).alias("_sum"))
    carry = sums.select(*per, F.sum("_sum").over(_window(keys, [bucket]).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    zero = F.lit(0).cast(df.schema[col].dataType)
    return inner.join(carry, per, "left").withColumn(name, F.col(name) + F.coalesce("_carry", zero)).drop("_carry")


def with_row_number(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the place of the row in the key's order, from 1."""
    return with_running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, bucket, order, "_one", name).drop("_one")
