"""Sinks: documents, append-only logs, subtitles, manifests (SNK)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import srt_time


def write_document(df: DataFrame, path: str) -> None:
    """Replace a small result as one JSON file (SNK1).

    It is written beside the old one, which makes way only when the new one is whole; a crash
    between the two renames leaves the old one as ``path``.old.
    """
    new, old = (f"{path.rstrip('/')}.{x}" for x in (f"new-{uuid.uuid4().hex}", "old"))
    df.coalesce(1).write.json(new)
    jvm = df.sparkSession._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} can't become {path}")
    fs.delete(at(old), True)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines (SNK2)."""
    df.write.mode("append").json(path)


def subtitle_blocks(df: DataFrame, key: str, number: str, start: str, end: str, text: str) -> DataFrame:
    """key, number, block: the blocks of a subtitle file (SNK4)."""
    block = F.concat_ws("\n", F.col(number).cast("string"), F.concat(srt_time(start), F.lit(" --> "), srt_time(end)), F.col(text))
    return df.select(key, F.col(number).alias("number"), block.alias("block"))


def write_subtitles(blocks: DataFrame, key: str, path: str) -> None:
    """One folder of text per key, blocks in order, a blank line between them (SNK4)."""
    ordered = blocks.repartition(F.col(key)).sortWithinPartitions(key, "number")
    ordered.select(key, F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def manifest(assets: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row with the counts a library shows (SNK5)."""
    a = assets.select("asset_id", "duration").distinct().agg(F.count("*").alias("asset_count"), F.round(F.sum(F.col("duration").cast("decimal(24,6)")), 3).cast("double").alias("total_duration"))
    s = scenes.select("scene_id").distinct().agg(F.count("*").alias("scene_count"))
    return a.join(F.broadcast(s))  # two single rows
