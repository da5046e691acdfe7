"""Sources: documents, logs of lines, tool output, media listings (SRC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of media files.
MEDIA_SUFFIXES = ["mp4", "mov", "m4v", "mkv", "avi", "mts"]


def json_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Whole JSON files, one object each, with an explicit schema (SRC1)."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def json_objects(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """As ``json_documents``, but files without an object at the root are an error (SRC2)."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(wide).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(paths).withColumn("_file", F.input_file_name())
    empty = F.lit(True)
    for f in schema.fields:
        empty = empty & F.col(f"`{f.name}`").isNull()
    bad = rows.filter(F.col("_bad").isNotNull() | empty).select("_file").limit(1).collect()
    if bad:
        raise ValueError(f"no object at the root of {bad[0][0]}")
    return rows.drop("_bad", "_file")


def parse_lines(lines: DataFrame, number: str, text: str, schema: str) -> DataFrame:
    """Lines of JSON, bad ones with a warning instead of fields (SRC3): number, row (struct or null), warning."""
    wide = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_r", F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.trim(text).startswith("{")
    row = F.struct(*(F.col(f"_r.{f.name}").alias(f.name) for f in T.StructType.fromDDL(schema).fields))
    return parsed.select(F.col(number), F.when(~bad, row).alias("row"), F.when(bad, F.concat(F.lit("line "), F.col(number).cast("string"), F.lit(" isn't an object"))).alias("warning"))


def media_files(spark: SparkSession, root: str) -> DataFrame:
    """Media files below a folder by suffix, hidden copies left out (SRC4): path, name, length, modified. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(MEDIA_SUFFIXES) & ~F.col("name").startswith("._"))


def unique_names(files: DataFrame, name: str, path: str) -> DataFrame:
    """Names that lead to exactly one path, whatever their case (SRC5): name, path."""
    n = files.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("_n"), F.min(path).alias("path"))
    return n.filter("_n = 1").drop("_n")


def metadata_pairs(lines: DataFrame, run: str, number: str, text: str, key: str) -> DataFrame:
    """Values of ``key=value`` lines with the time last printed before them (SRC7): run, timestamp, value.

    A time is used by one value only. A run is one tool's output, minutes of media long.
    """
    w = Window.partitionBy(run).orderBy(number)
    time = F.regexp_extract(text, r"pts_time:\s*(-?[0-9.]+)", 1)
    value = F.regexp_extract(text, rf"{key}=\s*(-?[0-9.]+)", 1)
    rows = lines.select(run, number, F.when(time != "", time).try_cast("double").alias("_t"), F.when(value != "", value).try_cast("double").alias("_v"))
    rows = rows.filter("_t IS NOT NULL OR _v IS NOT NULL").withColumn("_before", F.lag("_t").over(w)).filter("_v IS NOT NULL AND _before IS NOT NULL")
    return rows.select(run, F.col("_before").alias("timestamp"), F.col("_v").alias("value"))


def silences(logs: DataFrame, run: str, text: str, duration: str) -> DataFrame:
    """Silences of a detector's log: the i-th start with the i-th end, a missing end is the duration (SRC8): run, start, end."""
    nums = lambda what: F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"silence_{what}:\s*(-?[0-9.]+)"), F.lit(1)), lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    rows = logs.select(run, duration, nums("start").alias("_s"), nums("end").alias("_e")).select(run, duration, "_e", F.posexplode("_s").alias("_i", "start"))
    end: Column = F.coalesce(F.get("_e", F.col("_i")), F.col(duration))
    return rows.select(run, "start", end.alias("end")).filter(F.col("end") > F.col("start"))


def library(manifest: DataFrame, documents: DataFrame, path: str, groups: str) -> DataFrame:
    """Rows of the groups of the documents that a manifest lists (SRC6): manifest columns, group."""
    return manifest.join(documents, path).select(*manifest.columns, F.explode(groups).alias("group"))
