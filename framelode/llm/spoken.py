"""Marks of spoken text: clock marks, sound notes, hesitations. The patterns mean the same in Java and in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clock marks: 00:00:22.500, 00:02:18,000 -->, [00:09], (0:09), <00:22>.
CLOCK = r"(?:[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3}(?: ?--> ?(?:[0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3})?)?|[\[(<][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?[\])>])"
# What sound notes in round brackets say.
ROUND_NOTES = ["inaudible", "unintelligible", "laughter", "laughs", "laughing", "applause", "music", "crosstalk", "noise", "silence", "coughs", "sighs", "웃음", "박수", "음악", "잡음", "들리지 않음", "바람 소리", "문 닫는 소리", "笑", "拍手", "音楽", "Gelächter", "Applaus", "Musik", "rires", "applaudissements", "musique", "risas", "aplausos", "música", "risos"]
#: Sound notes: ((door slams)), [music], <crosstalk>, *wind noise*, (laughter), note signs.
NOTE = rf"(?:\(\([^()]*\)\)|\[[^\[\]]*\]|<[^<>]*>|\*[^*]*\*|\((?i:{'|'.join(ROUND_NOTES)})\)|[♪♫♬]+)"
# Hesitations that have no other meaning.
HESITATIONS = ["um", "umm", "uh", "uhh", "er", "erm", "hmm", "hm", "mm", "uhm", "you know", "음", "어", "ähm", "äh", "hum", "hã", "ahn", "euh", "eh", "えっと", "うーん", "ええと"]
# Words that hesitate only when a comma or dots follow or when they stand alone.
MAYBE_HESITATIONS = ["그", "저기", "あの", "also", "este", "pues", "tipo", "ben", "né"]
_EDGE = r"(?<![\p{L}\p{N}'’])", r"(?![\p{L}\p{N}'’])"
#: Any word that may hesitate, with the punctuation it brings.
ANY_HESITATION = rf"{_EDGE[0]}(?:{'|'.join(sorted(HESITATIONS + MAYBE_HESITATIONS, key=len, reverse=True))}){_EDGE[1]}(?:\.\.\.|…|[,、])?"
#: Words that hesitate where they stand, with the punctuation they bring.
SURE_HESITATION = rf"(?:{_EDGE[0]}(?:{'|'.join(sorted(HESITATIONS, key=len, reverse=True))}){_EDGE[1]}(?:\.\.\.|…|[,、])?|{_EDGE[0]}(?:{'|'.join(MAYBE_HESITATIONS)})(?:\.\.\.|…|[,、]))"
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_said(text: Column) -> Column:
    """The words of a spoken text as an array: lower case, without clock marks, sound notes,
    hesitations and doubled words. A text of nothing but hesitations gives those, one of
    nothing but a note the note's words, one without any word its signs. Null gives null.
    """
    words = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    plain = F.regexp_replace(F.lower(text), CLOCK, " ")

    def pick(t: Column) -> Column:
        spoken = F.regexp_replace(t, NOTE, " ")
        sure = words(F.regexp_replace(spoken, ANY_HESITATION, " "))
        return let(
            F.array(sure, words(spoken), words(t), F.array(F.regexp_replace(t, r"\s+", ""))),
            lambda xs: F.get(F.filter(xs, lambda x: F.size(x) > 0), F.lit(0)),
        )

    flat = let(plain, pick)
    bare = F.transform(flat, lambda w: F.regexp_replace(w, "['’]", ""))
    return let(bare, lambda a: F.filter(a, lambda w, i: (i == 0) | (w != F.get(a, i - 1))))


def same_words(a: Column, b: Column) -> Column:
    """Whether two word arrays say the same in the same words, apart from small slips.

    Slips are different word division and, in words of letters of an alphabet with five
    or more of them, one letter lost, doubled or changed, or two of them in one word
    with the same first letter. Numbers, short words and words in syllables or ideographs
    must be equal, as one sign there makes another statement.
    """
    once = lambda w: F.regexp_replace(w, r"(\p{L})\1+", "$1")

    def slip(p: Column) -> Column:
        x, y = p["x"], p["y"]
        letters = r"^[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{M}]+$"
        long = F.least(F.length(x), F.length(y)) >= 5
        two = F.left(x, F.lit(1)) == F.left(y, F.lit(1))
        near = lambda d: (d >= 0) & ((d <= 1) | two)
        close = let(F.levenshtein(x, y, 2), near) | let(F.levenshtein(once(x), once(y), 2), near)
        return (x == y) | (x.rlike(letters) & y.rlike(letters) & long & close)

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return (a == b) | (F.array_join(a, "") == F.array_join(b, "")) | ((F.size(a) == F.size(b)) & F.forall(pairs, slip))
