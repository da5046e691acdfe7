"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, SOURCES = 16_384, 10_000


def water_fill(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Size to draw of each source.

    Sources that would need more than their cap of repeats are clamped at it, and what they
    lack is given to the others in proportion to their shares, until none exceeds its cap.
    If all are at their caps, the total can't be reached.
    """
    most = {s: sizes.get(s, 0) * max(0.0, caps[s]) for s in shares}
    drawn: dict[str, float] = {}
    free = {s for s in shares if shares[s] > 0 and most[s] > 0}
    left = total
    while free:
        weight = sum(shares[s] for s in free)
        over = {s for s in free if left * shares[s] / weight >= most[s]}
        if not over:
            drawn |= {s: left * shares[s] / weight for s in free}
            break
        for s in over:
            drawn[s] = most[s]
        left -= sum(most[s] for s in over)
        free -= over
    return {s: drawn.get(s, 0.0) for s in shares}


def mixed(items: DataFrame, targets: DataFrame, id_col: str, source: str, size: str, *, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(draws, shares): items with their repeats, and per source its target and actual share.

    draws: id, source, size, repeats (at least 1). shares: source, target_share, actual_share,
    available, drawn, repeats (mean), at_cap. ``total`` defaults to the size of all items of
    sources with a target.

    Every item of a source is drawn floor(r) times; a seeded choice of items, in the order of a
    hash of their ids up to the wanted size, once more. The choice is cut inside one of ``BINS``
    hash bins, so only that bin is ordered. Whole totals per source are the only thing collected,
    one row for each of at most ``SOURCES`` targets.

    Cases: items without size, with a null id or with a source that has no target aren't drawn;
    targets without items get nothing and their share goes to the others; repeated rows count once.
    """
    aims = targets.select(F.col("source").alias("_src"), "target_share", "max_repeats").filter("_src IS NOT NULL").dropDuplicates(["_src"]).limit(SOURCES + 1).collect()
    if len(aims) > SOURCES:
        raise ValueError(f"at most {SOURCES} sources can have a target")
    spark = items.sparkSession
    shares = {r["_src"]: float(r["target_share"] or 0) for r in aims}
    caps = {r["_src"]: float(r["max_repeats"] or 0) for r in aims}
    rows = items.filter(F.col(id_col).isNotNull() & F.col(source).isin(list(shares)) & (F.col(size) > 0)).select(F.col(id_col).alias("_id"), F.col(source).alias("_src"), F.col(size).cast("long").alias("_n")).distinct()
    draw = F.pmod(F.xxhash64(F.col("_id"), F.lit(seed)), F.lit(BINS)).cast("int")
    rows = rows.withColumns({"_bin": draw, "_h": F.xxhash64(F.lit(seed), F.col("_id"), F.lit("order"))})
    bins = rows.groupBy("_src", "_bin").agg(F.sum("_n").alias("_in"))
    sizes = {r["_src"]: int(r["t"]) for r in bins.groupBy("_src").agg(F.sum("_in").alias("t")).collect()}
    want = water_fill(sizes, shares, caps, float(sum(sizes.values()) if total is None else total))
    plan = []
    for s, x in want.items():
        have = sizes.get(s, 0)
        whole = min(int(x // have), int(caps[s])) if have else 0
        plan.append((s, whole, float(x - whole * have)))
    wanted = spark.createDataFrame(plan, "_src string, _whole int, _more double") if plan else spark.createDataFrame([], "_src string, _whole int, _more double")
    upto = F.sum("_in").over(Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    edges = bins.withColumn("_upto", F.coalesce(upto, F.lit(0))).drop("_in")
    rows = rows.join(edges, ["_src", "_bin"]).join(F.broadcast(wanted), "_src")
    ends = F.col("_more") - F.col("_upto")
    # Bins wholly before the cut are taken, those wholly after it aren't; the one it falls into is ordered.
    inside = bins.select("_src", "_bin", "_in").join(edges, ["_src", "_bin"]).join(F.broadcast(wanted), "_src").filter("_upto < _more AND _upto + _in > _more").select("_src", "_bin")
    cut = rows.join(F.broadcast(inside), ["_src", "_bin"], "left_semi")
    so_far = F.sum("_n").over(Window.partitionBy("_src", "_bin").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("_take", (so_far - F.col("_n") / 2 <= ends).cast("int"))
    rest = rows.join(F.broadcast(inside), ["_src", "_bin"], "left_anti").withColumn("_take", (ends > 0).cast("int"))
    took = cut.unionByName(rest).withColumn("repeats", F.col("_whole") + F.col("_take")).filter("repeats > 0")
    draws = took.select(F.col("_id").alias(id_col), F.col("_src").alias(source), F.col("_n").alias(size), "repeats")
    got = draws.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(size) * F.col("repeats")).alias("drawn"))
    base = spark.createDataFrame([(s, shares[s], sizes.get(s, 0), want[s] >= sizes.get(s, 0) * caps[s]) for s in sorted(shares)], "source string, target_share double, available long, at_cap boolean")
    out = base.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    out = out.withColumn("_all", F.sum("drawn").over(Window.partitionBy(F.lit(0))))
    report = out.select("source", "target_share", F.round(F.col("drawn") / F.nullif("_all", F.lit(0)), 6).alias("actual_share"), "available", "drawn", F.round(F.col("drawn") / F.nullif("available", F.lit(0)), 6).alias("repeats"), "at_cap")
    return draws, report
