"""Clean, ordered speaker turns from raw transcripts (problem 3)."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sequence import with_last_known, with_next, with_previous, with_running_max
from ..session import cut_lineage
from .spoken import ANY_HESITATION, CLOCK, NOTE, SURE_HESITATION

BUCKET_S, RESET_S, ROSTER_ROWS = 600, 5.0, 10_000
PIECE = T.ArrayType(T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.IntegerType())]))

_CLOCK, _NOTE = regex.compile(CLOCK), regex.compile(NOTE)
_ANY, _SURE = regex.compile(ANY_HESITATION, regex.I), regex.compile(SURE_HESITATION, regex.I)
_BRACKET = regex.compile(r"[\[(<]([^\[\](){}<>]+)[\])>]\s?[:：]?")
_DELIMITER = regex.compile(r"\s?[:：]|\s[–—]\s")
_BEFORE = regex.compile(r"(?:(\S+)\s)?(\S+)$")
_WORD = regex.compile(r"[\p{L}\p{N}]")


def _plain(label: str) -> str:
    return regex.sub(r"[\s\-_.]+", "", unicodedata.normalize("NFKC", label)).casefold()


def _slip(a: str, b: str) -> bool:
    """Whether ``a`` is ``b`` with one letter lost, doubled or changed or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


class Roster:
    """Finds the speaker a label means: by name or other name, abbreviated, with leading zeros or a slip."""

    def __init__(self, names: list[tuple[str, str]]):
        self.exact: dict[str, str] = {}
        self.parts: list[tuple[str, str, str]] = []
        for other, speaker in names:
            self.exact.setdefault(_plain(other), speaker)
            if m := regex.fullmatch(r"(\p{L}{2,})[\s\-_]+(\p{L}|\p{N}+)", unicodedata.normalize("NFKC", other)):
                self.parts.append((m[1].casefold(), m[2].casefold().lstrip("0"), speaker))
        self.known: dict[str, str | None] = {}
        # A label isn't longer than the longest name with a slip and leading zeros.
        self.longest = 2 * max((len(other) for other, _ in names), default=0) + 8

    def find(self, label: str) -> str | None:
        if len(label) > 4 * self.longest:
            return None
        key = _plain(label)
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = self._find(key)
        return self.known[key]

    def _find(self, key: str) -> str | None:
        if not key or len(key) > self.longest:
            return None
        if key in self.exact:
            return self.exact[key]
        for word, mark, speaker in self.parts:
            head = key[: len(key) - len(mark)].rstrip("0") if mark.isdigit() else key[: len(key) - len(mark)]
            if head and key.endswith(mark) and head[0] == word[0] and (_slip(head, word) or self._short(head, word)):
                return speaker
        return next((s for k, s in self.exact.items() if len(k) >= 4 and k.isalpha() and key[0] == k[0] and _slip(key, k)), None)

    @staticmethod
    def _short(head: str, word: str) -> bool:
        rest = iter(word)
        return all(c in rest for c in head)

    def _marks(self, t: str) -> list[tuple[int, int, str]]:
        """Start, end and speaker of the labels of a text."""
        marks: list[tuple[int, int, str]] = []
        for m in _BRACKET.finditer(t):
            if who := self.find(m[1]):
                marks.append((m.start(), m.end(), who))
        for m in _DELIMITER.finditer(t):
            base = max(0, m.start() - 4 * self.longest)
            before = _BEFORE.search(t[base : m.start()])
            if not before:
                continue
            tries = [(before.start(2), before[2])]
            if before[1]:
                tries.insert(0, (before.start(1), f"{before[1]} {before[2]}"))
            for at, label in tries:
                bare = regex.sub(r"^[^\p{L}\p{N}]+", "", label)
                if who := self.find(bare):
                    marks.append((base + at, m.end(), who))
                    break
        return sorted(marks)

    def marked(self, text: str | None) -> bool:
        """Whether a text has a label."""
        return bool(text and self._marks(_CLOCK.sub(" ", text)))

    def pieces(self, text: str | None) -> list[tuple[str | None, str, int]]:
        """(speaker or None where the last label still holds, clean text, words) in the order of the text."""
        if not text:
            return []
        t = _CLOCK.sub(" ", text)
        cuts = [(0, 0, None), *self._marks(t)]
        out = []
        for (_, end, who), (nxt, _, _) in zip(cuts, [*cuts[1:], (len(t), 0, None)]):
            body = t[end : max(end, nxt)]
            said = _NOTE.sub(" ", body)
            words = sum(bool(_WORD.search(w)) for w in _ANY.sub(" ", said).split())
            clean = regex.sub(r"\s+", " ", regex.sub(r"^[\s>\-–—*]+|[\s>\-–—]+$", "", _SURE.sub(" ", said))).strip() if words else ""
            if words or who:
                out.append((who, clean, words))
        return out


def roster_names(roster: DataFrame, speaker: str, others: list[str]) -> list[tuple[str, str]]:
    """(name, speaker) pairs of a roster of at most ``ROSTER_ROWS`` rows; more is refused."""
    rows = roster.select(speaker, *others).distinct().limit(ROSTER_ROWS + 1).collect()
    if len(rows) > ROSTER_ROWS:
        raise ValueError(f"a roster has at most {ROSTER_ROWS} rows")
    return sorted((r[c], r[speaker]) for r in rows for c in [speaker, *others] if r[c] and r[speaker])


def isotonic(values: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing series in least squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v in values:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, n = blocks.pop()
            a, m = blocks[-1]
            blocks[-1] = [(a * m + b * n) / (m + n), m + n]
    return np.repeat([b for b, _ in blocks], [int(n) for _, n in blocks])


def repaired_times(df: DataFrame, key: str, place: str, start: str, end: str, *, reset: float = RESET_S, per_bucket: int = 2000) -> DataFrame:
    """Add ``fixed_start`` and ``fixed_end`` to the records of each ``key`` in the file order ``place`` (a whole number).

    Where the clock falls back by more than ``reset`` seconds a new file segment begins; it is
    moved to where the one before ended. Within a segment starts become non-decreasing by
    isotonic regression; only stretches that violate the order leave the JVM, as the
    regression decomposes at every place that nothing later undercuts. An end that is missing or
    before its start becomes the start. Rows with a null key, place or start are left out.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(place).isNotNull() & F.col(start).isNotNull() & ~F.isnan(start)).withColumn("_pb", F.floor(F.col(place) / per_bucket).cast("long"))
    rows = with_previous(rows, [key], "_pb", [place], [start], "_prev")
    rows = rows.withColumn("_cut", F.when(F.col(start) < F.col(f"_prev.{start}") - reset, F.col(place)))
    rows = with_last_known(rows, [key], "_pb", [place], "_cut", "_segment").withColumn("_segment", F.coalesce("_segment", F.lit(-1)))
    sizes = rows.groupBy(key, "_segment").agg(F.min(start).alias("_lo"), F.max(F.greatest(start, F.nanvl(F.col(end), F.col(start)))).alias("_hi"))
    w = Window.partitionBy(key).orderBy("_segment")
    shift = F.coalesce(F.lag("_hi").over(w) - F.col("_lo"), F.lit(0.0))
    sizes = sizes.withColumn("_gap", shift).withColumn("_shift", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(key, "_segment", "_shift")
    rows = rows.join(sizes, [key, "_segment"], "left").withColumn("_t", F.col(start) + F.col("_shift"))
    rows = with_running_max(rows, [key], "_pb", [place], "_t", "_before")
    # What follows is looked at in reverse order: the running maximum of the negated times.
    rows = rows.withColumns({"_back": -F.col(place), "_nb": -F.col("_pb"), "_nt": -F.col("_t")})
    rows = with_running_max(rows, [key], "_nb", ["_back"], "_nt", "_nafter")
    whole = F.col("_before").isNull() | (F.col("_before") <= F.least("_t", -F.col("_nafter")))
    rows = with_last_known(rows.withColumn("_head", F.when(whole, F.col(place))), [key], "_pb", [place], "_head", "_stretch")
    alone = (F.col("_stretch") == F.col(place)) & (F.col("_nafter").isNull() | (F.col("_t") <= -F.col("_nafter")))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ip", kind="stable")
        return pdf.assign(_iso=isotonic(pdf["_t"].to_numpy()))[["_ik", "_ip", "_iso"]]

    wrong = rows.filter(~alone).select(F.col(key).alias("_ik"), F.col("_stretch"), F.col(place).alias("_ip"), "_t")
    mended = wrong.groupBy("_ik", "_stretch").applyInPandas(pool, f"_ik {df.schema[key].dataType.simpleString()}, _ip {df.schema[place].dataType.simpleString()}, _iso double")
    out = rows.join(mended, (F.col(key) == F.col("_ik")) & (F.col(place) == F.col("_ip")), "left")
    fixed = F.coalesce("_iso", "_t")
    length = F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(end), F.col(start)), F.col(start)) - F.col(start))
    return out.select(*df.columns, F.round(fixed, 6).alias("fixed_start"), F.round(fixed + length, 6).alias("fixed_end"))


#: What a label can't do without, besides clock marks that have it too.
_MAY_LABEL = r"[:：\[(<]|\s[–—]\s"


def labelled(df: DataFrame, key: str, text: str, names: list[tuple[str, str]]) -> DataFrame:
    """The rows of the keys of which some text has a speaker label; only texts with a label's signs are read for it."""
    roster = df.sparkSession.sparkContext.broadcast(Roster(names))

    @F.pandas_udf("boolean")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(roster.value.marked)

    some = df.filter(F.regexp_replace(text, CLOCK, " ").rlike(_MAY_LABEL)).filter(marked(F.col(text)))
    return df.join(some.select(key).distinct(), key, "left_semi")


def spoken_pieces(df: DataFrame, key: str, time: str, end: str, id_col: str, place: str, text: str, names: list[tuple[str, str]], *, stated: bool = False) -> tuple[DataFrame, list[str]]:
    """(pieces of records with words and their speaker, the columns of their order).

    Pieces have _k, _b (bucket of the order), _id, _n (place in the record), _speaker, _clean,
    _words, and the repaired _at and _until of their record (see ``repaired_times``). Records follow
    each other by repaired time, so across clock resets in the file order ``place``, or, with
    ``stated``, by the stated time and only for equal ones by the repaired; a record without a
    place is taken at its stated time. A label holds until the next one, also beyond its record.
    Keys without any label, words before the first label of a key, and pieces of nothing but
    hesitations and sound notes are left out, as are rows with a null key, id or time. Whole-row
    copies count once.
    """
    roster = df.sparkSession.sparkContext.broadcast(Roster(names))

    @F.pandas_udf(PIECE)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(roster.value.pieces)

    rows = df.select(F.col(key).alias("_k"), F.col(id_col).alias("_id"), F.col(place).cast("long").alias("_place"), F.col(time).cast("double").alias("_start"), F.col(end).cast("double").alias("_end"), F.col(text).alias("_text"))
    rows = rows.filter("_k IS NOT NULL AND _id IS NOT NULL AND _start IS NOT NULL AND NOT isnan(_start)")
    # Written once, parsed: what follows reads it several times.
    rows = cut_lineage(labelled(rows, "_k", "_text", names).distinct().withColumn("_pieces", parse.asNondeterministic()("_text")).drop("_text"))
    times = repaired_times(rows.drop("_pieces").dropDuplicates(["_k", "_id"]), "_k", "_place", "_start", "_end").select("_k", "_id", "fixed_start", "fixed_end")
    rows = rows.join(times, ["_k", "_id"], "left").withColumns({"_at": F.coalesce("fixed_start", "_start"), "_until": F.coalesce("fixed_end", F.greatest("_start", F.coalesce(F.nanvl("_end", "_start"), "_start")))})
    order = ["_start", "_at", "_id", "_n"] if stated else ["_at", "_place", "_until", "_id", "_n"]
    pieces = rows.select("_k", "_start", "_at", "_until", "_place", "_id", F.posexplode("_pieces").alias("_n", "_p"), F.floor(F.col(order[0]) / BUCKET_S).cast("long").alias("_b"))
    pieces = cut_lineage(pieces.select("_k", "_b", *dict.fromkeys([*order, "_at", "_until"]), F.col("_p.speaker").alias("_label"), F.col("_p.text").alias("_clean"), F.col("_p.words").alias("_words")))
    held = with_last_known(pieces, ["_k"], "_b", order, "_label", "_speaker")
    return held.filter("_words > 0 AND _speaker IS NOT NULL"), order


def speaker_turns(df: DataFrame, key: str, time: str, end: str, id_col: str, place: str, text: str, names: list[tuple[str, str]], *, stated: bool = False) -> DataFrame:
    """Longest turns of one speaker: key, speaker, first_id, last_id (records that hold words of the turn); order as in ``spoken_pieces``."""
    said, order = spoken_pieces(df, key, time, end, id_col, place, text, names, stated=stated)
    heads = with_previous(said.drop("_clean"), ["_k"], "_b", order, ["_speaker", "_id"], "_before").filter("_before IS NULL OR _before._speaker <> _speaker")
    heads = with_next(heads.select("_k", "_b", *order, "_speaker", F.col("_before._id").alias("_prev_id")), ["_k"], "_b", order, ["_prev_id"], "_after")
    ends = said.groupBy("_k").agg(F.max_by("_id", F.struct(*order)).alias("_final"))
    return heads.join(ends, "_k").select(F.col("_k").alias(key), F.col("_speaker").alias("speaker"), F.col("_id").alias("first_id"), F.coalesce("_after._prev_id", "_final").alias("last_id"))


def clean_turns(df: DataFrame, spans: DataFrame, key: str, time: str, end: str, id_col: str, place: str, text: str, names: list[tuple[str, str]]) -> DataFrame:
    """Turns with clean text: key, turn (place of its first piece), part, speaker, start, end, confidence, text.

    Records, labels and turns follow the repaired times. Confidence is the mean of the records'
    span confidences weighted by words (null if no span has one). A turn's text is given in
    parts of at most ten minutes, so that a speaker without end doesn't become one endless value.
    """
    said, order = spoken_pieces(df, key, time, end, id_col, place, text, names)
    said = with_previous(said, ["_k"], "_b", order, ["_speaker"], "_before")
    said = said.withColumn("_head", F.when(F.col("_before").isNull() | (F.col("_before._speaker") != F.col("_speaker")), F.concat_ws("#", "_id", F.col("_n").cast("string"))))
    said = with_last_known(said, ["_k"], "_b", order, "_head", "_turn")
    sure = spans.select(F.col("utterance_id").alias("_id"), "span_index", "confidence").filter(F.col("confidence").isNotNull() & ~F.isnan("confidence")).distinct().groupBy("_id").agg(F.avg("confidence").alias("_c"))
    rows = said.join(sure, "_id", "left")
    counted = F.when(F.col("_c").isNotNull(), F.col("_words"))
    parts = rows.groupBy("_k", "_turn", "_b").agg(
        F.first("_speaker").alias("speaker"),
        F.min("_at").alias("start"),
        F.max("_until").alias("end"),
        F.round(F.sum(F.col("_c") * counted) / F.sum(counted), 4).alias("confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "_clean"))), lambda x: x["_clean"]), " ").alias("text"),
    )
    part = F.row_number().over(Window.partitionBy("_k", "_turn").orderBy("_b"))
    return parts.select(F.col("_k").alias(key), F.col("_turn").alias("turn"), part.cast("long").alias("part"), "speaker", "start", "end", "confidence", "text")
