"""Two functions Spark lacks, in Arrow batches, and their registration for SQL."""

from __future__ import annotations

import difflib
import posixpath
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def path_key(paths: pd.Series) -> pd.Series:
    """NFC, normalised path parts, case-folded: equal for paths that mean the same file."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", posixpath.normpath(p.replace("\\", "/"))).casefold())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two texts, without the junk heuristic."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Make ``path_key`` and ``sequence_ratio`` callable from SQL."""
    spark.udf.register("path_key", path_key)
    spark.udf.register("sequence_ratio", sequence_ratio)
