"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items with a length in (capacity / (k + 1), capacity / k] are class k; beyond this class they fill what is left.
CLASSES = 64
#: Items that one worker packs at a time; groups of it are independent.
GROUP_ITEMS = 50_000


def pack(lengths: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """A container number for each length (all at most ``capacity``).

    Harmonic packing from the longest class down: a container of class k is opened for k items
    of that class, which always fit. What they leave is filled from the largest class whose
    items are sure to fit, again and again, and at last with the smallest items in falling
    length. Every step takes an item by its class, so the time is linear.
    """
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    stacks: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in order:
        n = lengths[i]
        stacks[min(capacity // n, classes) if n else classes].append(i)
    place = [0] * len(lengths)
    opened = 0
    small = stacks[classes]
    for k in range(1, classes):
        while stacks[k]:
            room = capacity
            for _ in range(min(k, len(stacks[k]))):
                i = stacks[k].pop()
                place[i] = opened
                room -= lengths[i]
            j = k
            while room * classes >= capacity:
                # Every class from the first that is sure to fit; a longer item may fit by chance and is tried first.
                j = max(j, -(-capacity // room) - 1)
                while j < classes and not (stacks[j] and lengths[stacks[j][-1]] <= room) and not (stacks[j] and lengths[stacks[j][0]] <= room):
                    j += 1
                if j >= classes:
                    break
                at = stacks[j]
                i = at.pop() if lengths[at[-1]] <= room else at.pop(_longest_within(at, lengths, room))
                place[i] = opened
                room -= lengths[i]
            while small and lengths[small[-1]] <= room:
                room -= lengths[small[-1]]
                place[small.pop()] = opened
            opened += 1
    room = -1
    while small:
        i = small.pop()
        if lengths[i] > room:
            if room >= 0:
                opened += 1
            room = capacity
        place[i] = opened
        room -= lengths[i]
    return place


def _longest_within(rising: list[int], lengths: list[int], room: int) -> int:
    """Place of the longest item not over ``room`` in a list of rising lengths whose first fits."""
    low, high = 0, len(rising) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if lengths[rising[mid]] <= room else (low, mid - 1)
    return low


def packed(items: DataFrame, id_col: str, size: str, capacities: list[tuple[str, int]], *, group: int = GROUP_ITEMS) -> DataFrame:
    """Put every item into a container of each kind.

    Result: container_kind, container (unique within its kind), id, piece, from_token, tokens.
    Only an item longer than the capacity is cut: into full containers and a rest that is packed
    like any other item. Items are dealt by a hash of their id into groups of about ``group``,
    packed independently of each other; a group leaves at most a few containers half empty.

    Cases: null sizes and sizes below 1 count as 0 and take no room; null ids are left out;
    repeated rows count once; an empty table gives an empty result.
    """
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.greatest(F.lit(0), F.coalesce(F.col(size).cast("long"), F.lit(0))).alias("_n")).distinct()
    groups = max(1, -(-rows.count() // group))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("cap")) for k, c in capacities))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int")).withColumn("_k", F.explode(kinds))
    cap = F.col("_k.cap")
    full = F.floor((F.col("_n") - 1) / cap).cast("int")
    pieces = F.when(F.col("_n") > cap, F.sequence(F.lit(0), full)).otherwise(F.array(F.lit(0)))
    rows = rows.select("_id", "_g", F.col("_k.kind").alias("_kind"), cap.alias("_cap"), "_n", F.explode(pieces).alias("_piece"))
    start = F.col("_piece").cast("long") * F.col("_cap")
    rows = rows.select("_id", "_g", "_kind", "_cap", "_piece", start.alias("_from"), F.least(F.col("_cap"), F.col("_n") - start).alias("_len"))
    whole = rows.filter("_len = _cap").select(F.col("_kind").alias("container_kind"), F.concat_ws("-", F.lit("full"), F.col("_id").cast("string"), F.col("_piece").cast("string")).alias("container"), F.col("_id").alias(id_col), F.col("_piece").alias("piece"), F.col("_from").alias("from_token"), F.col("_len").alias("tokens"))
    kind = items.schema[id_col].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_len", "_id", "_piece"], kind="stable")
        where = pack(pdf["_len"].tolist(), int(pdf["_cap"].iloc[0]))
        g = int(pdf["_g"].iloc[0])
        return pd.DataFrame({"container_kind": pdf["_kind"].to_numpy(), "container": [f"{g}-{x}" for x in where], id_col: pdf["_id"].to_numpy(), "piece": pdf["_piece"].to_numpy(), "from_token": pdf["_from"].to_numpy(), "tokens": pdf["_len"].to_numpy()})

    rest = rows.filter("_len < _cap").groupBy("_kind", "_g").applyInPandas(fill, f"container_kind string, container string, `{id_col}` {kind}, piece int, from_token long, tokens long")
    return whole.unionByName(rest)


def fill_report(assigned: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Per kind: containers, tokens, least containers any packing needs, share of room filled."""
    caps = F.create_map(*[x for k, c in capacities for x in (F.lit(k), F.lit(c).cast("long"))])
    per = assigned.groupBy("container_kind", "container").agg(F.sum("tokens").alias("t"))
    out = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    cap = F.element_at(caps, F.col("container_kind"))
    return out.select("container_kind", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / cap).cast("long").alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("filled"))
