"""Greedy rules over ordered rows without a task per key: chains of segment starts and suppression.

Both work on arrays of one bucket of a key's time axis and look only as far beyond its edges as
the rule can see. What crosses edges is carried by a summary of each bucket (chains) or by
rounds with other edges (suppression).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Seconds of one bucket, and how far suppression may widen it.
BUCKET_S, WIDEST = 600.0, 1024
_PIECES = T.StructType([T.StructField("nxt", T.ArrayType(T.IntegerType())), T.StructField("froms", T.ArrayType(T.IntegerType())), T.StructField("exits", T.ArrayType(T.IntegerType())), T.StructField("lasts", T.ArrayType(T.IntegerType()))])
_ENTRIES = T.ArrayType(T.StructType([T.StructField("b", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("pb", T.LongType()), T.StructField("pi", T.IntegerType())]))
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("b", T.LongType()), T.StructField("i", T.IntegerType())]))


def _field(rows: str, name: str) -> Column:
    """One field of an array of structs as an array."""
    return F.transform(rows, lambda x: x[name])


def first_beyond(t: np.ndarray, reach: float, *, inclusive: bool = False) -> np.ndarray:
    """For each of the rising times the place of the first one more than ``reach`` later (or, ``inclusive``, at least)."""
    n = len(t)
    at = np.searchsorted(t, t + reach, side="left" if inclusive else "right")
    past = (lambda x: x >= reach) if inclusive else (lambda x: x > reach)
    # The sum may be rounded otherwise than the difference that decides.
    for _ in range(2):
        back = (at > 0) & past(t[np.maximum(at - 1, 0)] - t)
        at = at - back
        on = (at < n) & ~past(t[np.minimum(at, n - 1)] - t)
        at = at + on
    return at


def first_from(flags: np.ndarray) -> np.ndarray:
    """For each place the first flagged one at or after it; the length where there is none."""
    n = len(flags)
    return np.minimum.accumulate(np.where(flags, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, int)


def chained(df: DataFrame, keys: list[str], time: str, id_col: str, fields: list[str], horizon: float, following: Callable[..., np.ndarray], *, width: float = BUCKET_S) -> DataFrame:
    """Add ``segment`` (struct, in the key's order) and ``starts`` to rows: segments of which each one's start decides the next one's.

    ``following(times, *fields)`` gets the rows of a stretch in the order of time and id as
    arrays and gives for each row the place of the start that follows if a segment starts there
    (the number of rows if none of them does). A key's first row starts its first segment. A row
    more than ``horizon`` after a start must begin another segment, if no row before does.
    Fields are numbers. Rows without a time are left out.

    A bucket of ``width`` seconds is one array, with the rows up to ``horizon`` beyond it. For every place
    a bucket may be entered at, the place it is left at is worked out; equal neighbours are one
    piece. Only these pieces, a few for each bucket, meet in one task per key; they tell
    where each bucket is entered.
    """
    width = max(width, horizon)
    cols = [c for c in df.columns if c not in keys]
    rows = df.filter(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double"))).select(*keys, F.struct(F.col(time).cast("double").alias("__t"), F.col(id_col).alias("__i"), *(F.col(c).cast("double").alias(f"__f{k}") for k, c in enumerate(fields)), *cols).alias("_r"))
    b = F.floor(F.col("_r.__t") / width).cast("long")
    early = F.col("_r.__t") - b * width <= horizon
    rows = rows.select(*keys, "_r", F.explode(F.when(early, F.array(b, b - 1)).otherwise(F.array(b))).alias("_b"))
    own = F.floor(F.col("_r.__t") / width).cast("long") == F.col("_b")
    packed = rows.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_r")).alias("_rows"), F.count_if(own).cast("int").alias("_n")).filter("_n > 0")

    @F.pandas_udf(_PIECES)
    def pieces(n: pd.Series, t: pd.Series, *fs: pd.Series) -> pd.DataFrame:
        out = []
        for k in range(len(n)):
            m = int(n.iloc[k])
            nxt = np.asarray(following(np.asarray(t.iloc[k], dtype=float), *(np.asarray(f.iloc[k], dtype=float) for f in fs)), dtype=np.int64)[:m]
            exits, lasts = nxt - m, np.arange(m)
            for i in range(m - 1, -1, -1):
                if nxt[i] < m:
                    exits[i], lasts[i] = exits[nxt[i]], lasts[nxt[i]]
            new = np.flatnonzero(np.append(True, (np.diff(exits) != 0) | (np.diff(lasts) != 0))) if m else np.zeros(0, int)
            out.append((nxt.astype(np.int32), new.astype(np.int32), exits[new].astype(np.int32), lasts[new].astype(np.int32)))
        return pd.DataFrame(out, columns=["nxt", "froms", "exits", "lasts"])

    arrays = [_field("_rows", f) for f in ("__t", *(f"__f{k}" for k in range(len(fields))))]
    packed = cut_lineage(packed.withColumn("_p", pieces.asNondeterministic()("_n", *arrays)))

    @F.pandas_udf(_ENTRIES)
    def entries(buckets: pd.Series, sizes: pd.Series, froms: pd.Series, exits: pd.Series, lasts: pd.Series) -> pd.Series:
        def walk(bs, ns, fr, ex, la):
            at, before, out, past = 0, None, [], (None, None)
            for k, (b_, n) in enumerate(zip(bs, ns)):
                # Where the bucket right before ends, rows it has seen are counted from this one's first.
                if before is not None and b_ != before + 1:
                    at = 0
                before = b_
                if at >= n:
                    out.append((int(b_), -1, *past))
                    at = 0
                    continue
                out.append((int(b_), int(at), *past))
                p = int(np.searchsorted(fr[k], at, side="right")) - 1
                past = (int(b_), int(la[k][p]))
                at = int(ex[k][p])
            return out

        return pd.Series([walk(*x) for x in zip(buckets, sizes, froms, exits, lasts)], dtype=object)

    per = packed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_n", "_p.froms", "_p.exits", "_p.lasts"))).alias("_s"))
    per = per.withColumn("_e", entries.asNondeterministic()(*(_field("_s", f) for f in ("_b", "_n", "froms", "exits", "lasts"))))
    per = per.select(*keys, F.explode("_e").alias("_x")).select(*keys, F.col("_x.b").alias("_b"), F.col("_x.entry").alias("_entry"), F.col("_x.pb").alias("_pb"), F.col("_x.pi").alias("_pi"))

    @F.pandas_udf(_SEGMENTS)
    def segments(b_: pd.Series, n: pd.Series, nxt: pd.Series, entry: pd.Series, pb: pd.Series, pi: pd.Series) -> pd.Series:
        def mark(b0, m, nx, e, pb0, pi0):
            out = [(pb0, pi0)] * (m if e < 0 else int(e))
            while 0 <= e < m:
                to = min(int(nx[e]), m)
                out += [(int(b0), int(e))] * (to - int(e))
                e = to
            return [(None if x != x or x is None else int(x), None if y != y or y is None else int(y)) for x, y in out]

        return pd.Series([mark(*x) for x in zip(b_, n, nxt, entry, pb, pi)], dtype=object)

    done = packed.join(per, [*keys, "_b"]).withColumn("_seg", segments.asNondeterministic()("_b", "_n", "_p.nxt", "_entry", "_pb", "_pi"))
    flat = done.select(*keys, "_b", F.posexplode(F.arrays_zip(F.slice("_rows", F.lit(1), F.col("_n")).alias("r"), F.col("_seg").alias("s"))).alias("_i", "_x"))
    return flat.select(*keys, *(F.col(f"_x.r.{c}").alias(c) for c in cols), F.col("_x.s").alias("segment"), ((F.col("_x.s.b") == F.col("_b")) & (F.col("_x.s.i") == F.col("_i"))).alias("starts"))


def _decide(t: np.ndarray, known: np.ndarray, own: np.ndarray, near: Callable[[np.ndarray], np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(status, edge) of rows in the order of rank, ``t`` their times: 1 kept, 0 dropped, -1 not decided here.

    ``edge`` marks kept rows that may still drop a row that isn't decided yet.
    """
    n = len(t)
    place = np.argsort(t, kind="stable")
    times = t[place]
    low, high = np.searchsorted(times, t - reach - 1e-6), np.searchsorted(times, t + reach + 1e-6, side="right")
    status = np.full(n, -2)
    sorted_status = np.full(n, -2)
    where = np.empty(n, dtype=np.int64)
    where[place] = np.arange(n)
    for r in range(n):
        s = slice(low[r], high[r])
        close = near(times[s] - t[r])
        around = sorted_status[s]
        if (close & (around == 1)).any():
            x = 0
        elif known[r]:
            x = 1
        elif not own[r] or (close & (around == -1)).any():
            x = -1
        else:
            x = 1
        status[r] = sorted_status[where[r]] = x
    open_ = np.flatnonzero((sorted_status == -1) | ~own[place])
    edge = np.zeros(n, dtype=bool)
    if len(open_):
        at = times[open_]
        edge = (status == 1) & (np.searchsorted(at, t + reach + 1e-6, side="right") > np.searchsorted(at, t - reach - 1e-6))
    return status, edge


def suppressed(rows: DataFrame, keys: list[str], tolerance: float, *, inclusive: bool = True, width: float = 600.0) -> DataFrame:
    """Rows (_t double, _s double, _id) that greedy suppression keeps: taken by falling _s (nulls last), then _t, then _id, a row
    is kept if no kept one of its key lies within ``tolerance`` (not ``inclusive``: nearer).

    A row's fate rests on better rows within the tolerance alone. Each bucket of the time axis, with what lies
    within the tolerance of it, is decided by itself as far as its rows tell; the few rows that
    wait for others beyond an edge go into a next round with wider buckets and other edges,
    beside the kept rows near them. A round always decides the best waiting row of a key.
    """
    width = max(width, 4 * tolerance)
    todo = rows.select(*keys, "_t", "_s", "_id", F.lit(False).alias("_known"))
    kept, wide, turn = None, 1, 0
    kind = rows.schema["_id"].dataType
    out = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("status", T.IntegerType()), T.StructField("edge", T.BooleanType())]))

    @F.pandas_udf(out)
    def decide(t: pd.Series, known: pd.Series, own: pd.Series) -> pd.Series:
        near = (lambda d: np.abs(d) <= tolerance) if inclusive else (lambda d: np.abs(d) < tolerance)

        def one(ts, ks, os):
            os = np.asarray(os, dtype=bool)
            status, edge = _decide(np.asarray(ts, dtype=float), np.asarray(ks, dtype=bool), os, near, tolerance)
            mine = np.flatnonzero(os & (status != 0))
            return [(int(i) + 1, int(status[i]), bool(edge[i])) for i in mine]

        return pd.Series([one(*x) for x in zip(t, known, own)], dtype=object)

    while True:
        w, off = width * wide, (width * wide / 2 if turn % 2 else 0.0)
        bucket = lambda x, w=w, off=off: F.floor((x + off) / w).cast("long")
        here = bucket(F.col("_t"))
        spread = todo.withColumn("_own", here).withColumn("_b", F.explode(F.sequence(bucket(F.col("_t") - tolerance), bucket(F.col("_t") + tolerance))))
        item = F.struct((-F.coalesce("_s", F.lit(float("-inf")))).alias("n"), "_t", "_id", "_s", "_known", (F.col("_own") == F.col("_b")).alias("own"))
        packed = spread.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(item)).alias("_r"))
        packed = packed.withColumn("_d", decide.asNondeterministic()(*(_field("_r", f) for f in ("_t", "_known", "own"))))
        flat = packed.select(*keys, "_r", F.explode("_d").alias("_x")).select(*keys, F.element_at("_r", F.col("_x.at")).alias("_e"), F.col("_x.status").alias("_status"), F.col("_x.edge").alias("_edge"))
        flat = cut_lineage(flat.select(*keys, "_e._t", "_e._s", "_e._id", "_e._known", "_status", "_edge"))
        new = flat.filter("_status = 1 AND NOT _known").select(*keys, "_t", "_s", F.col("_id").cast(kind).alias("_id"))
        kept = new if kept is None else kept.unionByName(new)
        if flat.filter("_status = -1").isEmpty():
            return kept
        todo = flat.filter("_status = -1 OR _edge").select(*keys, "_t", "_s", "_id", (F.col("_status") == 1).alias("_known"))
        turn, wide = turn + 1, min(wide * 2, WIDEST)
