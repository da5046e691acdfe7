"""Streams over the append-only tables: latest job state and sessions (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, time: str = "ts") -> DataFrame:
    """New parquet files of a folder as a stream; the time becomes a TIMESTAMP, as watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, *, late: str = "1 hour") -> DataFrame:
    """Sessions that a pause of ``gap`` ends, on batch and stream alike; rows later than ``late`` are dropped in a stream."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest_state(events: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The last event of each key (A16); on a stream as a running result (update or complete mode)."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_x"))
    return last.select(*keys, "_x.*")


def run_available(df: DataFrame, out: str, *, mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is there and stop (ST2): parquet at ``out``, each batch written once; the state lies in ``out``_state unless ``checkpoint`` names a folder."""
    start(df, out, mode=mode, checkpoint=checkpoint, once=True).awaitTermination()


def start(df: DataFrame, out: str, *, mode: str = "append", checkpoint: str | None = None, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """A running query that looks for new input ``every`` so often (ST2), or once; see ``run_available``."""
    w = df.writeStream.option("checkpointLocation", checkpoint or out.rstrip("/") + "_state").outputMode(mode)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=every)
    if mode == "append":
        return w.format("parquet").option("path", out).start()
    return w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()


def due(jobs: DataFrame, events: DataFrame, key: str, time: str, event: str, now, *, seconds: int) -> DataFrame:
    """Jobs to run (ST1, ST2, P16): those never completed since their last start, whose latest failure isn't within ``seconds`` before ``now``.

    Of events of one time a completion counts before a start. Null keys are left out.
    """
    e = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    per = e.groupBy(key).agg(
        F.max_by(event, F.struct(F.col(time), F.col(event))).alias("_last"),
        F.max(F.when(F.col(event) == "failed", F.col(time))).alias("_failed"),
    )
    x = jobs.filter(F.col(key).isNotNull()).join(per, key, "left")
    rested = F.col("_failed").isNull() | (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("_failed").cast("timestamp")) >= seconds * 1_000_000)
    return x.filter(~F.col("_last").eqNullSafe("completed") & rested).drop("_last", "_failed")


def unchanged(inputs: DataFrame, signatures: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Inputs whose content has no stored signature yet and must be computed (ST4): columns and ``signature``."""
    sign = F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
    return inputs.withColumn("signature", sign).join(signatures.select(key, "signature"), [key, "signature"], "left_anti")


def stage_status(stages: DataFrame, asset: str, status: str) -> DataFrame:
    """Status of an asset over its stages (ST5): failed, awaiting what a stage awaits, reused only if all are, else completed."""
    s = F.col(status)
    return stages.groupBy(asset).agg(
        F.when(F.count_if(s == "failed") > 0, "failed").when(F.count_if(s.startswith("awaiting")) > 0, F.min(F.when(s.startswith("awaiting"), s))).when(F.every(s == "reused"), "reused").otherwise("completed").alias("status")
    )


def stage_chain(records: DataFrame, asset: str, place: str, status: str) -> DataFrame:
    """Adds ``effective`` to stages of a fixed chain (ST5): what comes after the first stage that failed or waits is blocked, and after one that ran anew nothing is reused.

    ``place`` counts the stages of an asset, which are few. Assets don't touch each other.
    """
    w = Window.partitionBy(asset).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    s = F.col(status)
    stopped = F.coalesce(F.max((s == "failed") | s.startswith("awaiting")).over(w), F.lit(False))
    anew = F.coalesce(F.max(s == "completed").over(w), F.lit(False))
    return records.withColumn("effective", F.when(stopped, "blocked").when(anew & (s == "reused"), "completed").otherwise(s))
