"""One form for texts that look the same (problem 4)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Letters of other scripts that print like a Latin letter.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Һ": "h", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "Տ": "S", "Օ": "O",
    # hyphens that print like the one on the keyboard
    "‐": "-", "‑": "-", "﹣": "-", "－": "-",
    # apostrophe-like letters
    "ʼ": "’", "＇": "'",
}
# Kinds of compatibility decomposition whose two sides print the same.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}
#: Ranges of one block of the unstable class; a character is tested against the edges of a block before its ranges.
BLOCK = 24


@lru_cache(maxsize=200_000)
def _spread(ch: str) -> str:
    """A character without its width and ligature forms, canonically decomposed; blanks become a space, inkless ones vanish."""
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch in "\t\n\r\x0b\x0c":
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or ch in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    parts = unicodedata.decomposition(ch)
    if parts and (parts[0] != "<" or parts.split(" ", 1)[0] in SAME_LOOK):
        codes = [x for x in parts.split() if x[0] != "<"]
        return "".join(_spread(chr(int(x, 16))) for x in codes)
    return unicodedata.normalize("NFD", ch)


def canonical(text: str) -> str:
    """The form all look-alikes of ``text`` share. Capitals, accents, digits and distinct signs stay as they are."""
    spread = unicodedata.normalize("NFD", "".join(map(_spread, text)))
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in spread))


@lru_cache(maxsize=1)
def _assigned() -> tuple[str, ...]:
    """All characters of all planes that have a meaning."""
    return tuple(ch for ch in map(chr, range(0x110000)) if unicodedata.category(ch) not in ("Cn", "Co", "Cs"))


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that can join the one before them: the quick-check answer 'maybe'."""
    parts = (unicodedata.decomposition(ch) for ch in _assigned())
    second = {chr(int(d.split()[-1], 16)) for d in parts if d and d[0] != "<" and " " in d}
    return frozenset(second | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)})


@lru_cache(maxsize=1)
def unstable_class() -> str:
    """A Java character class of all characters whose quick check isn't 'yes': they change, vanish or may join a neighbour.

    Java tests the ranges of a class one by one, so they are grouped into blocks, and printable
    ASCII, syllables and ideographs are ruled out before.
    """
    maybe = _composing()
    plain = lambda cp: 0x20 <= cp < 0x7F or 0xAC00 <= cp < 0xD7A4 or 0x4E00 <= cp < 0x9FFF
    codes = [ord(ch) for ch in _assigned() if not plain(ord(ch)) and (ch in maybe or unicodedata.combining(ch) or canonical(ch) != ch)]
    spans: list[list[int]] = []
    for cp in codes:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    code = lambda c: f"\\x{{{c:X}}}"
    both = lambda a, b: code(a) if a == b else f"{code(a)}-{code(b)}"
    blocks = [spans[i : i + BLOCK] for i in range(0, len(spans), BLOCK)]
    inside = "".join(f"[{both(x[0][0], x[-1][1])}&&[{''.join(both(*s) for s in x)}]]" for x in blocks)
    return rf"[[^\x20-\x7E\x{{AC00}}-\x{{D7A3}}\x{{4E00}}-\x{{9FFE}}]&&[{inside}]]"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _canonical_segments(segments: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(s: str) -> str:
        if s not in known:
            if len(known) > 100_000:
                known.clear()
            known[s] = canonical(s)
        return known[s]

    return segments.map(lambda xs: None if xs is None else [one(x) for x in xs])


def canonical_text(df: DataFrame, col: str, name: str) -> DataFrame:
    """Add ``name``: ``col`` with every unstable segment replaced by its canonical form.

    Unstable segments are runs of characters that fail the normalisation quick check, with
    the character before them as boundary context. They alone go to Python, in Arrow
    batches; the stable text between them is spliced back unchanged in the JVM.

    Cases: null stays null, empty stays empty; the result is idempotent; very long texts
    cost only their unstable segments.
    """
    pattern = F.lit(rf"(?s)(?:[^\n]{unstable_class()}+|{unstable_class()}+)")
    text = F.col(col)
    out = df.withColumn("_segments", F.when(text.rlike(r"[^\x20-\x7E]"), F.regexp_extract_all(text, pattern, F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>")))
    # Declared nondeterministic so that Catalyst evaluates it once, however often its result is read.
    out = out.withColumn("_mended", _canonical_segments.asNondeterministic()("_segments"))
    spliced = F.array_join(F.zip_with(F.split(text, pattern, -1), F.col("_mended"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return out.withColumn(name, F.when(F.size("_mended") > 0, spliced).otherwise(text)).drop("_segments", "_mended")


def _spellings(df: DataFrame, id_col: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(_id, _f, _v) of all values, and (_f, _c, _v, _n, _all) of the spellings of a form that has several; _n and _all count ids."""
    values = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(cols)))).alias("_x"))
    members = values.select("_id", F.col("_x.f").alias("_f"), F.col("_x.v").alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    # Written once, with the Python work done: what follows reads it several times.
    forms = cut_lineage(canonical_text(members.groupBy("_f", "_v").agg(F.count("*").alias("_n")), "_v", "_c"))
    many = forms.groupBy("_f", "_c").agg(F.count("*").alias("_spelled"), F.sum("_n").alias("_all")).filter("_spelled > 1").drop("_spelled")
    return members, forms.join(many, ["_f", "_c"])


def look_alike_classes(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Classes of values that look the same but are different strings, one row for each spelling.

    Result: field, canonical, spelling, members (rows with it) and links (rows of the class
    with another spelling, to each of which each member is linked). Values without another
    spelling are in no class. Nulls as in ``look_alike_pairs``.
    """
    _, forms = _spellings(df, id_col, cols)
    field = F.element_at(F.array(*map(F.lit, cols)), F.col("_f") + 1)
    return forms.select(field.alias("field"), F.col("_c").alias("canonical"), F.col("_v").alias("spelling"), F.col("_n").alias("members"), (F.col("_all") - F.col("_n")).alias("links"))


def look_alike_pairs(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows of which one of ``cols`` looks the same in both but is another string.

    The classes of ``look_alike_classes`` expanded to pairs of rows: only different strings are
    paired, through one row per string; rows with the very same string are never joined with
    each other, however many there are. Null ids and null
    values have no pairs; an empty table gives an empty result; repeated rows count once.
    """
    members, forms = _spellings(df, id_col, cols)
    a = forms.select("_f", "_c", F.col("_v").alias("_va"))
    b = forms.select("_f", "_c", F.col("_v").alias("_vb"))
    pairs = a.join(b, ["_f", "_c"]).filter("_va < _vb").select("_f", "_va", "_vb")
    left = members.select("_f", F.col("_v").alias("_va"), F.col("_id").alias("_ia"))
    right = members.select("_f", F.col("_v").alias("_vb"), F.col("_id").alias("_ib"))
    both = pairs.join(left, ["_f", "_va"]).join(right, ["_f", "_vb"]).filter("_ia <> _ib")
    return both.select(F.least("_ia", "_ib").alias(f"{id_col}_a"), F.greatest("_ia", "_ib").alias(f"{id_col}_b")).distinct()
