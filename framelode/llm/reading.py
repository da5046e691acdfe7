"""Reading level of documents by a Rasch-style latent model of words and documents (problem 10)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Latent levels are searched on a grid, which bounds what the driver gathers: a few numbers per grid place.
GRID = np.linspace(-4.0, 4.0, 81)
ROUNDS, RIDGE, PSEUDO, MOVED = 6, 2.0, 0.5, 0.02
#: Up to so many of the most frequent words their parameters are sent to all workers; rarer ones are joined by shuffle.
SENT_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_numbers: dict[str, int] = {}


@F.pandas_udf(T.StructType([T.StructField("ws", T.ArrayType(T.LongType())), T.StructField("ns", T.ArrayType(T.IntegerType()))]))
def _counted(texts: pd.Series) -> pd.DataFrame:
    found = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
    if len(_numbers) > 500_000:
        _numbers.clear()
    new = list({w for c in found for w in c if w not in _numbers})
    if new:
        _numbers.update(zip(new, pd.util.hash_array(np.array(new, dtype=object), categorize=False).view(np.int64).tolist()))
    return pd.DataFrame({"ws": [[_numbers[w] for w in c] for c in found], "ns": [list(c.values()) for c in found]})


def word_counts(df: DataFrame, id_col: str, text: str, *keep: str) -> DataFrame:
    """_d, _ws, _ns, _size and the kept columns: the words of each document with their counts, one row per document.

    Words are 64-bit hashes. Whole texts are counted; null and empty texts have no words. Rows of one id count once.
    """
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_d"), *keep, _counted(F.col(text)).alias("_x"))
    rows = rows.select("_d", *keep, F.col("_x.ws").alias("_ws"), F.col("_x.ns").alias("_ns"))
    return rows.withColumn("_size", F.aggregate("_ns", F.lit(0).cast("long"), lambda a, n: a + n)).dropDuplicates(["_d"])


class Slopes:
    """Slopes of words by hash; those of words not among them are 0."""

    def __init__(self, words: np.ndarray, slopes: np.ndarray):
        order = np.argsort(words)
        self.words, self.slopes = words[order], slopes[order]

    def has(self, words: np.ndarray) -> np.ndarray:
        return self.words[self._at(words)] == words if len(self.words) else np.zeros(len(words), dtype=bool)

    def of(self, words: np.ndarray) -> np.ndarray:
        return np.where(self.has(words), self.slopes[self._at(words)], 0.0) if len(self.words) else np.zeros(len(words))

    def _at(self, words: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)


def _flat(ws: pd.Series, ns: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a batch, their counts and the rows they belong to."""
    sizes = ws.map(len).to_numpy()
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(ws.to_list()).astype(np.int64), np.concatenate(ns.to_list()).astype(float), np.repeat(np.arange(len(ws)), sizes)


def _pull(ws: pd.Series, ns: pd.Series, slopes: Slopes) -> np.ndarray:
    words, n, row = _flat(ws, ns)
    return np.bincount(row, weights=n * slopes.of(words), minlength=len(ws))


def _levels(size: np.ndarray, pull: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place on the grid of the most likely level, with a standard normal prior."""
    return (pull[:, None] * GRID - size[:, None] * z - 0.5 * GRID**2).argmax(1)


def _refined(size: np.ndarray, pull: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The most likely level between grid places: a Newton step from the best one."""
    f = pull[:, None] * GRID - size[:, None] * z - 0.5 * GRID**2
    k = np.clip(f.argmax(1), 1, len(GRID) - 2)
    rows = np.arange(len(k))
    low, mid, high = f[rows, k - 1], f[rows, k], f[rows, k + 1]
    bend = np.minimum(low - 2 * mid + high, -1e-12)
    return GRID[k] + (GRID[1] - GRID[0]) * np.clip((low - high) / (2 * bend), -1, 1)


def _sums(docs: DataFrame, slopes: Slopes | None, z: np.ndarray | None, *, only: Slopes | None = None, placed: bool = False) -> DataFrame:
    """_w, _c, _ct, _k: summed counts per word and, with a null word, sizes (_c) and documents (_ct) per grid place _k.

    One pass over the documents without any shuffle before the sums. Documents stand where
    ``slopes`` put them; without slopes where their grade does, and those without one are left
    out; ``placed`` ones where _k says. With ``only``, just its words are summed.
    """
    sent = docs.sparkSession.sparkContext.broadcast((slopes, only))
    last = "_k" if placed else "_at"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, some = sent.value
        for pdf in parts:
            if not placed and known is None:
                pdf = pdf[pdf["_at"].notna()]
            pdf = pdf[pdf["_size"] > 0].reset_index(drop=True)
            if not len(pdf):
                continue
            words, n, row = _flat(pdf["_ws"], pdf["_ns"])
            size = pdf["_size"].to_numpy(float)
            if placed:
                k = pdf["_k"].to_numpy(int)
            elif known is None:
                k = np.abs(pdf["_at"].to_numpy(float)[:, None] - GRID).argmin(1)
            else:
                k = _levels(size, np.bincount(row, weights=n * known.of(words), minlength=len(pdf)), z)
            at = GRID[k][row]
            if some is not None:
                inside = some.has(words)
                words, n, at = words[inside], n[inside], at[inside]
            names, codes = np.unique(words, return_inverse=True)
            yield pd.DataFrame({"_w": pd.array(names, dtype="Int64"), "_c": np.bincount(codes, weights=n, minlength=len(names)), "_ct": np.bincount(codes, weights=n * at, minlength=len(names)), "_k": -1})
            places = np.unique(k)
            yield pd.DataFrame({"_w": pd.array([None] * len(places), dtype="Int64"), "_c": np.bincount(k, weights=size, minlength=len(GRID))[places], "_ct": np.bincount(k, minlength=len(GRID))[places].astype(float), "_k": places})

    return docs.select("_ws", "_ns", "_size", last).mapInPandas(run, "_w long, _c double, _ct double, _k int").groupBy("_w", "_k").agg(F.sum("_c").alias("_c"), F.sum("_ct").alias("_ct"))


def _fitted(c: np.ndarray, ct: np.ndarray, exposure: np.ndarray, mean: float, spread: float, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and slope of words by Newton steps on the Poisson likelihood of each one's counts.

    What all words share, the running words written at each level, enters through ``exposure``.
    """
    share = exposure / exposure.sum()
    c0, c1 = c + PSEUDO, (ct - mean * c) / spread + PSEUDO * float((share * grid).sum())
    a, b = np.log(c0 / exposure.sum()), np.zeros(len(c))
    for _ in range(8):
        rate = np.exp(np.clip(a[:, None] + b[:, None] * grid, -40, 5)) * exposure
        s0, s1, s2 = rate.sum(1), (rate * grid).sum(1), (rate * grid**2).sum(1) + RIDGE
        g0, g1 = c0 - s0, c1 - s1 - RIDGE * b
        det = np.maximum(s0 * s2 - s1**2, 1e-12)
        a += np.clip((s2 * g0 - s1 * g1) / det, -1, 1)
        b += np.clip((s0 * g1 - s1 * g0) / det, -1, 1)
    return a, b


def _fit_words(sums: DataFrame, exposure: np.ndarray, mean: float, spread: float, grid: np.ndarray) -> DataFrame:
    """_w, _c, _base, _slope of all words."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            a, b = _fitted(pdf["_c"].to_numpy(float), pdf["_ct"].to_numpy(float), exposure, mean, spread, grid)
            yield pd.DataFrame({"_w": pdf["_w"], "_c": pdf["_c"], "_base": a, "_slope": b})

    return sums.filter("_w IS NOT NULL").select("_w", "_c", "_ct").mapInPandas(fit, "_w long, _c double, _base double, _slope double")


def _totals(words: DataFrame) -> np.ndarray:
    """Summed rate of all words at each grid place; every partition sends that many numbers."""

    def part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(GRID))
        for pdf in parts:
            total += np.exp(pdf["_base"].to_numpy()[:, None] + pdf["_slope"].to_numpy()[:, None] * GRID).sum(0)
        yield pd.DataFrame({"k": np.arange(len(GRID)), "z": total})

    out = np.zeros(len(GRID))
    for r in words.mapInPandas(part, "k int, z double").groupBy("k").agg(F.sum("z").alias("z")).collect():
        out[r["k"]] = r["z"]
    return out


class _Tail:
    """The words too rare to be sent: (document, word, count) rows, which meet word parameters in shuffle joins.

    The most frequent words of all documents, at most ``sent_words``, are the head. A word of the
    tail is rarer than any of them, so no join on words has a hot key.
    """

    def __init__(self, docs: DataFrame, counts: DataFrame, sent_words: int):
        octave = F.floor(F.log2(F.greatest(F.col("_c"), F.lit(1.0)))).cast("int")
        per = {r["o"]: r["n"] for r in counts.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect()}
        least, n = max(per) + 1, 0
        while least - 1 in per and n + per[least - 1] <= sent_words:
            least -= 1
            n += per[least]
        rows = counts.filter(octave >= least).select("_w").toPandas()
        self.head = Slopes(rows["_w"].to_numpy(np.int64), np.zeros(len(rows)))
        sent = docs.sparkSession.sparkContext.broadcast(self.head)

        def rare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                w, n_, row = _flat(pdf["_ws"], pdf["_ns"])
                out = ~sent.value.has(w)
                yield pd.DataFrame({"_d": pdf["_d"].to_numpy()[row[out]], "_w": w[out], "_n": n_[out]})

        kind = docs.schema["_d"].dataType.simpleString()
        self.rows = cut_lineage(docs.select("_d", "_ws", "_ns").mapInPandas(rare, f"_d {kind}, _w long, _n double"))

        @F.pandas_udf("boolean")
        def is_head(words: pd.Series) -> pd.Series:
            return pd.Series(sent.value.has(words.to_numpy(np.int64)))

        self.is_head = is_head("_w")

    def pulled(self, docs: DataFrame, words: DataFrame, slopes: Slopes) -> DataFrame:
        """_d, _size, _pull of all documents, from words of both kinds."""
        sent = docs.sparkSession.sparkContext.broadcast(slopes)

        @F.pandas_udf("double")
        def near(ws: pd.Series, ns: pd.Series) -> pd.Series:
            return pd.Series(_pull(ws, ns, sent.value))

        far = self.rows.join(words.filter(~self.is_head).select("_w", "_slope"), "_w").groupBy("_d").agg(F.sum(F.col("_n") * F.col("_slope")).alias("_far"))
        return docs.select("_d", "_size", near("_ws", "_ns").alias("_near")).join(far, "_d", "left").select("_d", "_size", (F.col("_near") + F.coalesce("_far", F.lit(0.0))).alias("_pull"))

    def sums(self, docs: DataFrame, words: DataFrame, slopes: Slopes, z: np.ndarray) -> DataFrame:
        """As ``_sums``."""

        @F.pandas_udf("int")
        def place(size: pd.Series, pull: pd.Series) -> pd.Series:
            return pd.Series(_levels(size.to_numpy(float), pull.to_numpy(float), z))

        theta = cut_lineage(self.pulled(docs, words, slopes).select("_d", place("_size", "_pull").alias("_k")))
        at = F.element_at(F.array(*map(F.lit, GRID.tolist())), F.col("_k") + 1)
        far = self.rows.join(theta, "_d").groupBy("_w").agg(F.sum("_n").alias("_c"), F.sum(F.col("_n") * at).alias("_ct")).select("_w", F.lit(-1).alias("_k"), "_c", "_ct")
        return _sums(docs.join(theta, "_d"), None, None, only=self.head, placed=True).select("_w", "_k", "_c", "_ct").unionByName(far)


def fit_levels(counts: DataFrame, grades: DataFrame, id_col: str, grade: str, *, rounds: int = ROUNDS, sent_words: int = SENT_WORDS) -> DataFrame:
    """_d, the kept columns, theta and level: latent level of each document, and the same on the scale of the grades.

    A word's occurrences in a document are Poisson with rate ``words * exp(base + slope * theta)``: the
    Rasch model of counts, in which a document's level and a word's difficulty meet, with a
    slope per word. Words are fitted given levels and levels given words, alternately, until
    levels move little; the first word step uses graded documents alone, which anchors the
    direction. A round reads the documents once and shuffles one row per word and task; beyond
    ``sent_words`` words the rarer ones meet their parameters in shuffle joins, with the same result. Grades of a
    document are reduced to their median; the line from theta to grades is fitted three times,
    each time without grades more than three off.

    Cases: documents without words get theta 0 and no level; null grades are ignored; without two
    different grades theta is 0 and level null; words of a single document and ties are fine.
    """
    marks = grades.select(F.col(id_col).alias("_d"), F.col(grade).cast("double").alias("_g")).filter("_d IS NOT NULL AND _g IS NOT NULL").groupBy("_d").agg(F.percentile("_g", F.lit(0.5)).alias("_g"))
    docs = cut_lineage(counts.join(marks, "_d", "left"))
    keep = [c for c in counts.columns if c not in ("_d", "_ws", "_ns", "_size")]
    about = docs.filter("_size > 0").agg(F.count("_g").alias("n"), F.avg("_g").alias("m"), F.stddev_pop("_g").alias("s")).first()
    if not about["n"] or not about["s"]:
        return docs.select("_d", *keep, F.lit(0.0).alias("theta"), F.lit(None).cast("double").alias("level"))
    docs = docs.withColumn("_at", (F.col("_g") - about["m"]) / about["s"])
    mean, spread = 0.0, 1.0
    words = slopes = z = tail = None
    for _ in range(rounds):
        sums = cut_lineage(tail.sums(docs, words, slopes, z) if tail else _sums(docs, slopes, z))
        size, number = np.zeros(len(GRID)), np.zeros(len(GRID))
        for r in sums.filter("_w IS NULL").collect():
            size[r["_k"]], number[r["_k"]] = r["_c"], r["_ct"]
        before = (mean, spread)
        mean = float((number * GRID).sum() / number.sum())
        spread = float(np.sqrt((number * (GRID - mean) ** 2).sum() / number.sum())) or 1.0
        words = _fit_words(sums, size, mean, spread, (GRID - mean) / spread)
        if tail is None and sums.count() - len(GRID) <= sent_words:
            some = words.select("_w", "_base", "_slope").toPandas()
            z = sum((np.exp(x["_base"].to_numpy()[:, None] + x["_slope"].to_numpy()[:, None] * GRID).sum(0) for x in (some[i : i + 50_000] for i in range(0, len(some), 50_000))), np.zeros(len(GRID)))
        else:
            words = cut_lineage(words)
            z = _totals(words)
            # The first words are those of graded documents; the head is chosen among those of all.
            tail = tail or _Tail(docs, _sums(docs, Slopes(np.zeros(0, np.int64), np.zeros(0)), z).filter("_w IS NOT NULL"), sent_words)
            some = words.filter(tail.is_head).select("_w", "_slope").toPandas()
        slopes = Slopes(some["_w"].to_numpy(np.int64), some["_slope"].to_numpy(float))
        if max(abs(mean - before[0]), abs(spread - before[1])) < MOVED and before != (0.0, 1.0):
            break
    if tail:

        @F.pandas_udf("double")
        def refined(size: pd.Series, pull: pd.Series) -> pd.Series:
            return pd.Series(_refined(size.to_numpy(float), pull.to_numpy(float), z))

        out = docs.join(tail.pulled(docs, words, slopes).select("_d", refined("_size", "_pull").alias("theta")), "_d", "left")
    else:
        sent = docs.sparkSession.sparkContext.broadcast(slopes)

        @F.pandas_udf("double")
        def theta(size: pd.Series, ws: pd.Series, ns: pd.Series) -> pd.Series:
            return pd.Series(_refined(size.to_numpy(float), _pull(ws, ns, sent.value), z))

        out = docs.withColumn("theta", theta("_size", "_ws", "_ns"))
    out = out.withColumn("theta", F.when(F.col("_size") > 0, F.col("theta")).otherwise(0.0))
    out = cut_lineage(out.select("_d", *keep, "_size", "_g", "theta"))
    pairs = out.filter("_g IS NOT NULL AND _size > 0")
    slope, base, kept = 0.0, float(about["m"]), pairs
    for _ in range(3):
        r = kept.agg(F.regr_slope("_g", "theta").alias("s"), F.regr_intercept("_g", "theta").alias("i")).first()
        if r["s"] is None:
            break
        slope, base = r["s"], r["i"]
        kept = pairs.filter(F.abs(F.col("_g") - (base + slope * F.col("theta"))) <= 3)
    return out.select("_d", *keep, F.round("theta", 6).alias("theta"), F.when(F.col("_size") > 0, F.round(base + slope * F.col("theta"), 4)).alias("level"))
