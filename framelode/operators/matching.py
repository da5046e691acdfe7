"""Rules that bring two sides of ids, paths, runs or shards together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import with_row_number


def numbered(df: DataFrame, id_col: str, name: str = "number", *, prefix: int = 7) -> DataFrame:
    """Add ``name``: the place of each row in the order of its id over the whole table, from 1.

    Rows are numbered inside groups of ids that begin alike (``prefix`` characters); only the groups' sizes meet in one task.
    """
    x = df.withColumns({"_all": F.lit(1), "_b": F.substring(id_col, 1, prefix)})
    return with_row_number(x, ["_all"], "_b", [id_col], name).drop("_all", "_b")


def shard(df: DataFrame, id_col: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th id from the ``index``-th on, in the order of ids."""
    if not 1 <= index <= count:
        raise ValueError("a shard is one of 1 to count")
    return numbered(df.select(id_col).distinct(), id_col, "_n").filter((F.col("_n") - 1) % count == index - 1).drop("_n")


def listed(df: DataFrame, name: str, include: DataFrame | None, exclude: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``name`` is on the first list and not on the second, names of the lists that no row has) (P8). The latter are errors."""
    rows, lists = df, [x.select(F.col(x.columns[0]).alias(name)) for x in (include, exclude) if x is not None]
    if include is not None:
        rows = rows.join(lists[0], name, "left_semi")
    if exclude is not None:
        rows = rows.join(lists[-1], name, "left_anti")
    unknown = None
    for x in lists:
        gone = x.distinct().join(df, name, "left_anti")
        unknown = gone if unknown is None else unknown.unionByName(gone).distinct()
    return rows, unknown if unknown is not None else df.select(name).limit(0)


def aligned_runs(rows: DataFrame, window: list[str], run: str, value: str) -> DataFrame:
    """Runs side by side (J16): window columns, runs (sorted), missing (of all runs of the table), values (sorted distinct), differ.

    The number of different runs is small and the same for all windows; null runs are left out.
    """
    x = rows.filter(F.col(run).isNotNull()).groupBy(*window, run).agg(F.array_sort(F.collect_set(value)).alias("_v"))
    known = x.agg(F.array_sort(F.collect_set(run)).alias("_all"))
    by = x.groupBy(*window).agg(F.array_sort(F.collect_set(run)).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_v")))).alias("values"), F.count_distinct("_v").alias("_n"))
    out = by.join(F.broadcast(known))
    return out.select(*window, "runs", F.array_except("_all", "runs").alias("missing"), "values", ((F.col("_n") > 1) | (F.size("runs") < F.size("_all"))).alias("differ"))


def ends_with_parts(path, suffix):
    """Whether the parts of a path, case folded, end with those of another; a null or empty one never does."""
    parts = lambda c: F.filter(F.split(F.lower(c), r"[/\\]+"), lambda x: (x != "") & (x != "."))
    p, q = parts(path), parts(suffix)
    return F.coalesce((F.size(q) > 0) & (F.size(p) >= F.size(q)) & (F.slice(p, F.greatest(F.lit(1), F.size(p) - F.size(q) + 1), F.greatest(F.lit(1), F.size(q))) == q), F.lit(False))


def suffix_matches(paths: DataFrame, path: str, suffixes: DataFrame, suffix: str) -> DataFrame:
    """Rows of both sides whose path ends with the suffix (J19). Joined on the last part, so that only paths of one name meet."""
    last = lambda c: F.element_at(F.split(F.lower(F.regexp_replace(c, r"[/\\]+$", "")), r"[/\\]+"), -1)
    a = paths.filter(F.col(path).isNotNull()).withColumn("_last", last(path))
    b = suffixes.filter(F.length(suffix) > 0).withColumn("_last", last(suffix))
    return a.join(b, "_last").filter(ends_with_parts(F.col(path), F.col(suffix))).drop("_last")


def only_candidates(left: DataFrame, left_key: str, right: DataFrame, right_key: str, id_col: str, name: str) -> DataFrame:
    """Left rows with ``name``, the ``id_col`` of the one right row of their key, where there is exactly one."""
    one = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key")).agg(F.count("*").alias("_n"), F.min(id_col).alias(name)).filter("_n = 1").drop("_n")
    return left.join(one, F.col(left_key) == F.col("_key")).drop("_key")


def overridden(defaults: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """key, ``value``, origin, problem (J21): an accepted override, else a verified default, else an error; a key overridden twice is one too.

    ``defaults``: key, value, verified. ``overrides``: key, value, accepted.
    """
    o = overrides.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.when(F.col("accepted"), F.col(value))).alias("_o"))
    x = defaults.select(key, F.when(F.col("verified"), F.col(value)).alias("_d")).join(o, key, "left")
    twice = F.coalesce(F.col("_n") > 1, F.lit(False))
    origin = F.when(F.col("_o").isNotNull(), "override").when(F.col("_d").isNotNull(), "default")
    problem = F.when(twice, "overridden twice").when(origin.isNull(), "no accepted override and no verified default")
    return x.select(key, F.when(problem.isNull(), F.coalesce("_o", "_d")).alias(value), F.when(problem.isNull(), origin).alias("origin"), problem.alias("problem"))


def merged_shards(parts: DataFrame, expected: DataFrame, id_col: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all shards with ``place`` in the packet's order, id and problem of what forbids the merge).

    ``expected``: id, order. An id in several shards, one that isn't expected and one that no shard holds are
    problems; a caller merges only if there is none.
    """
    n = parts.groupBy(id_col).agg(F.count("*").alias("_n"))
    x = expected.select(id_col, order).join(n, id_col, "full_outer")
    problem = F.when(F.col("_n") > 1, "in several shards").when(F.col("_n").isNull(), "in no shard").when(F.col(order).isNull(), "not expected")
    placed = parts.join(expected.select(id_col, F.col(order).alias("place")), id_col)
    return placed, x.select(id_col, problem.alias("problem")).filter("problem IS NOT NULL")


def multiset_differences(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """cols, left, right: values that two tables hold in different numbers (A23); nulls equal each other."""
    side = lambda df, l, r: df.select(*cols).groupBy(*cols).count().select(*cols, (F.col("count") * l).alias("left"), (F.col("count") * r).alias("right"))
    both = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*cols).agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    return both.filter(F.col("left") != F.col("right"))
