"""Runs of repeated records in ordered sequences (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_previous
from ..session import cut_lineage
from .spoken import same_words, words_said

BUCKET_S = 600


def repeated_runs(df: DataFrame, keys: list[str], time: str, end: str, id_col: str, text: str, *, bucket: float = BUCKET_S) -> DataFrame:
    """Longest runs of at least two consecutive records of a key that say the same thing.

    Result: keys, first_id, last_id, records, start, seconds (from the first start to the
    greatest end or start of the run).

    Consecutive means next in the order of ``time``, then ``id_col``, blank texts left out. A
    record that says the same as its predecessor points to it; pointers are then replaced by
    their pointers' pointers in logarithmically many self-joins until all reach run starts.
    Pointers still moving are all different, so the joins have no hot key, and those that
    arrived take no further part. Each round is checkpointed.

    Cases: rows with a null key, id or time and blank texts are left out; repeated rows count
    once; ties on ``time`` go by id; a null end counts as no end; empty tables give an empty
    result; other columns, whatever their names, aren't read.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(a) for k, a in zip(keys, ks)), F.col(time).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    for c in [*ks, "_id", "_s"]:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.filter(~F.isnan("_s") & F.col("_text").rlike(r"[^\s\p{Z}\p{Cf}]")).withColumn("_b", F.floor(F.col("_s") / bucket).cast("long"))
    # One exchange serves the removal of copies and the look-back.
    rows = rows.repartition(*ks, "_b").dropDuplicates()
    rows = rows.select(*ks, "_b", "_s", F.greatest("_s", F.nanvl("_e", "_s")).alias("_e"), "_id", words_said(F.col("_text")).alias("_w"))
    rows = with_previous(rows, ks, "_b", ["_s", "_id"], ["_id", "_s", "_e", "_w"], "_p")
    links = rows.filter(F.col("_p").isNotNull() & same_words(F.col("_w"), F.col("_p._w"))).select(
        *ks, "_id", F.col("_p._id").alias("_to"), F.col("_p._s").alias("_s"), F.greatest("_e", "_p._e").alias("_e"), F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_done")
    )
    links = cut_lineage(links)
    while not links.filter("NOT _done").isEmpty():
        ahead = links.select(*ks, F.col("_id").alias("_to"), F.col("_to").alias("_to2"), F.col("_s").alias("_s2"), F.col("_e").alias("_e2"), F.col("_n").alias("_n2"))
        moved = links.filter("NOT _done").join(ahead, [*ks, "_to"], "left")
        moved = moved.select(
            *ks, "_id", F.coalesce("_to2", "_to").alias("_to"), F.coalesce("_s2", "_s").alias("_s"), F.greatest("_e", "_e2").alias("_e"), (F.col("_n") + F.coalesce("_n2", F.lit(0))).alias("_n"), F.col("_to2").isNull().alias("_done")
        )
        links = cut_lineage(links.filter("_done").unionByName(moved))
    runs = links.groupBy(*ks, "_to").agg(F.max_by("_id", "_n").alias("last_id"), (F.max("_n") + 1).alias("records"), F.min("_s").alias("start"), F.max("_e").alias("_e"))
    return runs.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), F.col("_to").alias("first_id"), "last_id", "records", "start", F.round(F.col("_e") - F.col("start"), 6).alias("seconds"))
