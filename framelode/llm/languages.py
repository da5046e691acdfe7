"""Languages of texts and of the stretches of mixed ones (problem 2)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ftrl
from .spoken import CLOCK, HESITATIONS, NOTE

LANGUAGES = ["en", "ko", "ja", "de", "fr", "es", "pt"]
# Ways of writing a language besides its two-letter code.
WRITTEN = {
    "eng": "en", "english": "en", "kor": "ko", "korean": "ko", "한국어": "ko", "jpn": "ja", "jp": "ja", "japanese": "ja", "日本語": "ja",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "español": "es", "por": "pt", "portuguese": "pt", "português": "pt",
}
# Labels that name no language.
UNDETERMINED = ["", "und", "unknown", "undetermined", "mul", "mis", "zxx", "xx", "none", "null", "n/a", "na", "auto", "?", "-", "--"]
#: Rows sampled for training, clauses taken of one row and characters of one clause. The sample never grows with the data.
#: It isn't stratified: among rows of a rare label the wrongly labelled ones of a common language would prevail.
SAMPLE_ROWS, CLAUSES_PER_ROW, CLAUSE_CHARS = 16_000, 3, 400
#: What makes a clause: words of an alphabet, words in Hangul with so many syllables, kana and ideographs.
MIN_WORDS, MIN_HANGUL_WORDS, MIN_HANGUL, MIN_KANA = 4, 3, 7, 8
#: Words that are searched at once for several changes of language; longer clauses are searched piece by piece.
CUT_WORDS = 200

_JUNK = re.compile(rf"{CLOCK}|{NOTE}|^[ \t]*[0-9]+[ \t]*$|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:[.,][0-9]{{3}})?(?: ?--> ?)?", re.M)
_SENTENCE = re.compile(r"[^.!?。！？\n]+")
_TRIGGER = re.compile(r"[\[(<*♪♫♬:]")
_WIDE = re.compile(r"[\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
_ALPHABET = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNIT = re.compile(r"([぀-ヿ㐀-鿿々〆ー]+)|([가-힣]+)|([^\W\d_぀-ヿ㐀-鿿々〆가-힣]+(?:['’][^\W\d_぀-ヿ㐀-鿿々〆가-힣]+)*)")
_HESITATIONS = frozenset(h for w in HESITATIONS for h in (w, w.capitalize(), w.upper()))
SEGMENT = T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def label_code(label: Column) -> Column:
    """Two-letter code of a label, however written; null if it is missing or names none."""
    low = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    main = F.regexp_extract(low, r"^([^\-_@.]*)", 1)
    known = F.create_map(*[F.lit(x) for kv in WRITTEN.items() for x in kv])
    return F.when(low.isNull() | low.isin(UNDETERMINED) | main.isin(UNDETERMINED), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, main), main))


def grams(unit: str) -> Iterator[str]:
    """Character n-grams of a word with its edges: up to five letters; of syllables and ideographs up to two, and their script."""
    u = f"^{unit.lower()}$"
    wide = unit[0] > "\u3000"
    if wide:
        for c in unit:
            yield "#hangul" if "\uac00" <= c <= "\ud7a3" else "#kana" if c < "\u3400" else "#ideograph"
    for n in range(1, 3 if wide else 6):
        for i in range(len(u) - n + 1):
            yield u[i : i + n]


def blanked(text: str) -> str:
    """The text with clock marks, sound notes, subtitle numbers and dots of hesitation blanked out; offsets stay."""
    plain = _JUNK.sub(lambda m: " " * len(m.group(0)), text) if _TRIGGER.search(text) else text
    return plain.replace("...", "   ").replace("…", " ") if ".." in plain or "…" in plain else plain


def clauses(text: str) -> list[tuple[list[str], int, int]]:
    """Clauses of a text as (words, start, end).

    Sentences are cut where the script changes, but single foreign words, such as names,
    stay out of a clause. What is too short to be a clause (interjections, labels) is left out,
    and hesitations aren't counted.
    """
    plain = blanked(text)
    found: list[tuple[list[str], int, int]] = []
    narrow = not _WIDE.search(plain)
    for m in _SENTENCE.finditer(plain):
        part = m.group(0)
        if narrow or not _WIDE.search(part):
            words = _ALPHABET.findall(part)
            if len(words) >= MIN_WORDS:
                if not _HESITATIONS.isdisjoint(words):
                    words = [w for w in words if w not in _HESITATIONS]
                    if len(words) < MIN_WORDS:
                        continue
                found.append((words, m.start() + len(part) - len(part.lstrip()), m.end() - len(part) + len(part.rstrip())))
            continue
        runs: list[list[tuple[str, int, int]]] = [[]]
        by: tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]] = ([], [])
        for u in _UNIT.finditer(plain, m.start(), m.end()):
            w = u.group(0)
            if w in _HESITATIONS:
                continue
            unit = (w, u.start(), u.end())
            if u.lastindex == 3:
                runs[-1].append(unit)
            else:
                by[u.lastindex - 1].append(unit)
                if runs[-1]:
                    runs.append([])
        groups = [r for r in runs if len(r) >= MIN_WORDS]
        if sum(len(u[0]) for u in by[0]) >= MIN_KANA:
            groups.append(by[0])
        if len(by[1]) >= MIN_HANGUL_WORDS and sum(len(u[0]) for u in by[1]) >= MIN_HANGUL:
            groups.append(by[1])
        found += [([u[0] for u in g], g[0][1], g[-1][2]) for g in groups]
    return found


class Model:
    """Weights per n-gram, folded to scores per word; small enough to be sent to every worker."""

    def __init__(self, table: dict[str, np.ndarray], idf: dict[str, float], bias: np.ndarray, rest: float, heat: float):
        self.table, self.idf, self.bias, self.rest, self.heat = table, idf, bias, rest, heat
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES) + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _add(self, unit: str) -> int:
        """A new number for a word; its row holds the summed weighted n-grams per language and, last, the sum of its TF-IDF."""
        k = len(self.ids)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        v = np.zeros(len(LANGUAGES) + 1)
        for g in grams(unit):
            f = self.idf.get(g, self.rest)
            v[-1] += f
            if (w := self.table.get(g)) is not None:
                v[:-1] += f * w
        self.rows[k] = v
        self.ids[unit] = k
        return k

    def numbers(self, words: list[str]) -> list[int]:
        try:
            return [self.ids[w] for w in words]
        except KeyError:
            return [self.ids[w] if w in self.ids else self._add(w) for w in words]

    def chances(self, sums: np.ndarray) -> np.ndarray:
        return ftrl.softmax((SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + self.bias) / self.heat)

    def cut(self, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        """Where the words of a clause change language within, with the chances before and after; None if they don't."""
        n = len(rows)
        before = rows.cumsum(axis=0)[MIN_WORDS - 1 : n - MIN_WORDS]
        a, b = self.chances(before), self.chances(rows.sum(axis=0) - before)
        both = a.max(axis=1) * b.max(axis=1)
        both[a.argmax(axis=1) == b.argmax(axis=1)] = 0
        k = int(both.argmax())
        at = k + MIN_WORDS
        lean = rows[:, :-1].argmax(axis=1)
        sides = (lean[:at] == a[k].argmax()).sum() >= MIN_WORDS - 1 and (lean[at:] == b[k].argmax()).sum() >= MIN_WORDS - 1
        return (at, a[k], b[k]) if both[k] >= SPLIT_CHANCE and sides else None

    def stretches(self, rows: np.ndarray, whole: np.ndarray | None = None) -> list[tuple[int, int, np.ndarray]]:
        """Stretches of one language of a clause's words as (from, to, chances), however often they change."""
        n = len(rows)
        ends = []
        if n >= 2 * MIN_WORDS:
            if split := self.cut(rows):
                ends = [split[0], n]
            elif n > CUT_WORDS * 3 // 2:
                # What is the same language on both sides of a window's edge is merged later.
                ends = [*range(CUT_WORDS, n - CUT_WORDS // 2, CUT_WORDS), n]
            elif n >= 3 * MIN_WORDS and (found := self._several(rows)):
                return found
        if len(ends) < 2:
            return [(0, n, self.chances(rows.sum(axis=0)[None])[0] if whole is None else whole)]
        return [(s + at, e + at, p) for at, to in zip([0, *ends], ends) for s, e, p in self.stretches(rows[at:to])]

    def _several(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray]] | None:
        """The fewest stretches, three at least, whose chances' product is enough; None where there are none."""
        n = len(rows)
        lean = rows[:, :-1].argmax(axis=1)
        all_votes = np.bincount(lean, minlength=rows.shape[1] - 1)
        if (all_votes >= MIN_WORDS - 1).sum() < 2:
            return None
        total = np.vstack([np.zeros(rows.shape[1]), rows.cumsum(axis=0)])
        votes = np.vstack([np.zeros(rows.shape[1] - 1, dtype=np.int64), (lean[:, None] == np.arange(rows.shape[1] - 1)).cumsum(axis=0)])
        begin, stop = np.triu_indices(n + 1, MIN_WORDS)
        lead = votes[stop] - votes[begin] >= MIN_WORDS - 1
        # A stretch in another language than most words' must be among them; few pairs of places are looked at for it.
        other = lead.copy()
        other[:, all_votes.argmax()] = False
        far = np.flatnonzero(other.any(axis=1))
        if not ((self.chances(total[stop[far]] - total[begin[far]]) >= SPLIT_CHANCE) & other[far]).any():
            return None
        p = self.chances(total[stop] - total[begin])
        ok = (p >= SPLIT_CHANCE) & lead
        # At most one language of a stretch can have so much of the chance.
        use = np.flatnonzero(ok.any(axis=1))
        steps = [(int(stop[k]), int(begin[k]), int(p[k].argmax()), math.log(p[k].max()), p[k]) for k in use]
        steps.sort(key=lambda x: x[:2])
        # reached[(place, language)] = (log of the product, stretches)
        reached: dict[tuple[int, int], tuple[float, list]] = {(0, -1): (0.0, [])}
        for k in range(1, n // MIN_WORDS + 1):
            nxt: dict[tuple[int, int], tuple[float, list]] = {}
            for e, s, c, x, px in steps:
                for d in range(-1, len(LANGUAGES)):
                    if d != c and (was := reached.get((s, d))) and was[0] + x >= math.log(SPLIT_CHANCE) and ((e, c) not in nxt or was[0] + x > nxt[e, c][0]):
                        nxt[e, c] = (was[0] + x, [*was[1], (s, e, px)])
            reached = nxt
            done = [v for (e, _), v in reached.items() if e == n]
            if k >= 3 and done:
                return max(done, key=lambda v: v[0])[1]
            if not reached:
                break
        return None

    def _scored(self, texts: list[str | None]) -> tuple | None:
        """Clauses of all texts with their words, chances and likeliest languages, and those that may be in several; None without any.

        Words are scored by table look-up, clauses of all texts together in a few array steps.
        """
        if len(self.ids) > 300_000:
            self._forget()
        flat: list[int] = []
        begins: list[int] = []
        spans: list[tuple[int, int, int]] = []
        wordy: list[list[str]] = []
        for i, t in enumerate(texts):
            if t:
                for words, s, e in clauses(t):
                    begins.append(len(flat))
                    flat += self.numbers(words)
                    spans.append((i, s, e))
                    wordy.append(words)
        if not spans:
            return None
        at = np.array(flat, dtype=np.int64)
        first = np.array(begins, dtype=np.int64)
        p = self.chances(np.add.reduceat(self.rows[at], first, axis=0))
        top = p.argmax(axis=1)
        sizes = np.diff(np.append(first, len(at)))
        # Words that lean to another language than their clause; those without any weight lean nowhere.
        known = self.rows[: len(self.ids), :-1]
        lean = np.where(known.max(axis=1) > known.mean(axis=1), known.argmax(axis=1), -1)[at]
        # A stretch has that many words that lean to its language, and one of several isn't in the clause's language.
        n = len(LANGUAGES) + 1
        votes = np.bincount(np.repeat(np.arange(len(top)), sizes) * n + lean + 1, minlength=len(top) * n).reshape(-1, n)[:, 1:]
        votes[np.arange(len(top)), top] = 0
        doubtful = (sizes >= 2 * MIN_WORDS) & (votes.max(axis=1) >= MIN_WORDS - 1)
        return spans, wordy, begins, sizes, at, p, top, doubtful

    def wholly(self, texts: list[str | None], language: str) -> list[bool]:
        """Whether ``segments`` finds stretches of ``language`` alone, at least one.

        A clause that is surely in another language and in no more than one decides that of the whole text. Such
        clauses are looked for at the beginning of texts first; the others are searched whole.
        """
        c = LANGUAGES.index(language)
        heads = [_beginning(t) if t else None for t in texts]
        gone: set[int] = set()
        if got := self._scored(heads):
            spans, _, _, _, _, p, top, doubtful = got
            gone = {spans[k][0] for k in np.flatnonzero((top != c) & ~doubtful & (p.max(axis=1) >= DOUBT))}
        found = self.segments([None if i in gone else t for i, t in enumerate(texts)])
        return [bool(x) and all(y[0] == language for y in x) for x in found]

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its stretches of one language in order; none for null and for texts without a clause."""
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
        got = self._scored(texts)
        if got is None:
            return out
        spans, wordy, begins, sizes, at, p, top, may = got
        doubtful = set(np.flatnonzero(may).tolist())
        best = p[np.arange(len(top)), top].tolist()
        k, n = 0, len(spans)
        tops = top.tolist()
        while k < n:
            i = spans[k][0]
            found: list[tuple[int, float, int, int, np.ndarray]] = []
            while k < n and spans[k][0] == i:
                _, s, e = spans[k]
                parts = self.stretches(self.rows[at[begins[k] : begins[k] + int(sizes[k])]], p[k]) if k in doubtful else []
                if len(parts) > 1:
                    edges = [_word_place(texts[i], wordy[k], b, s, e) for b, _, _ in parts[1:]]
                    for (_, _, px), lo, hi in zip(parts, [s, *(m[1] for m in edges)], [*(m[0] for m in edges), e]):
                        found.append((int(px.argmax()), float(px.max()), lo, hi, px))
                else:
                    found.append((tops[k], best[k], s, e, p[k]))
                k += 1
            sure = {c for c, x, _, _, _ in found if x >= DOUBT}
            merged: list[list] = []
            found.sort(key=lambda x: x[2])
            for c, x, s, e, px in found:
                if x < DOUBT and sure and c not in sure:
                    other = max(sure, key=px.__getitem__)
                    if px[other] >= 1 - DOUBT:
                        c, x = other, float(px[other])
                if merged and merged[-1][0] == c:
                    last = merged[-1]
                    last[1] += (e - s) * x
                    last[2] += e - s
                    last[4] = max(last[4], e)
                else:
                    merged.append([c, (e - s) * x, e - s, s, e])
            out[i] = [(LANGUAGES[c], round(mass / max(1, size), 4), s, e) for c, mass, size, s, e in merged]
        return out


_BEGINNING = re.compile(r".*(?<!\.)[.!?。！？](?=\s)", re.S)


def _beginning(text: str) -> str | None:
    """Whole first sentences of a text, some hundred characters; None where marks might reach beyond them."""
    head = text[:600]
    if _TRIGGER.search(head) or not (m := _BEGINNING.match(head)):
        return None
    return m.group(0)


def _word_place(text: str, words: list[str], at: int, start: int, end: int) -> tuple[int, int]:
    """End of the word before place ``at`` of a clause and start of the word at it."""
    pos = start
    last = start
    for i, w in enumerate(words[: at + 1]):
        pos = text.find(w, pos, end)
        if i == at:
            return last, pos
        pos = last = pos + len(w)
    return last, last


#: TF-IDF rows sum up to the first; a clause is cut in two if the product of both chances reaches the second; below the last, the likeliest language that the text surely holds is taken if it has the rest of the chance.
SCALE, SPLIT_CHANCE, DOUBT = 20.0, 0.85, 0.97


def train(examples: list[tuple[list[str], str]], *, seed: int = 7) -> Model:
    """Fit on (words of a clause, language) pairs with some wrong languages among them.

    A first fit finds the examples whose own label it finds improbable; those are left out
    of the second. A tenth is held out for the temperature.
    """
    seen = Counter(w for words, _ in examples for w in set(words))
    per_word = {w: Counter(grams(w)) for w in seen}
    spread: Counter = Counter()
    for words, _ in examples:
        spread.update(set().union(*(per_word[w].keys() for w in words)))
    names = {g: i for i, g in enumerate(sorted(g for g, n in spread.items() if n >= 3))}
    total = max(1, len(examples))
    idf = {g: math.log((1 + total) / (1 + spread[g])) + 0.1 for g in names}
    rest = math.log(1 + total) + 0.1
    parts = {}
    for w, c in per_word.items():
        inside = [(names[g], n * idf[g]) for g, n in c.items() if g in names]
        parts[w] = (np.array([i for i, _ in inside], dtype=np.int64), np.array([v for _, v in inside]), sum(n * idf.get(g, rest) for g, n in c.items()))
    rows = []
    for words, _ in examples:
        mass = sum(parts[w][2] for w in words) or 1.0
        at, where = np.unique(np.concatenate([parts[w][0] for w in words]), return_inverse=True)
        value = np.bincount(where, weights=np.concatenate([parts[w][1] for w in words]), minlength=len(at))
        rows.append((np.append(at, len(names)).astype(np.int32), np.append(SCALE * value / mass, 1.0).astype(np.float32)))
    y = np.array([LANGUAGES.index(k) for _, k in examples], dtype=np.int64)
    x = ftrl.Sparse(rows)
    held = np.arange(len(y)) % 10 == 9
    pick = lambda which: ftrl.Sparse([rows[i] for i in np.flatnonzero(which)])
    first = ftrl.fit(pick(~held), y[~held], len(names) + 1, len(LANGUAGES), epochs=2, seed=seed)
    own = ftrl.softmax(ftrl.scores(first, x))
    good = (own.argmax(axis=1) == y) | (own[np.arange(len(y)), y] >= 0.3)
    w = ftrl.fit(pick(~held & good), y[~held & good], len(names) + 1, len(LANGUAGES), epochs=5, seed=seed)
    test = held & good
    heat = ftrl.temperature(ftrl.scores(w, pick(test)), y[test]) if test.sum() >= 20 else 1.0
    table = {g: w[i] for g, i in names.items() if w[i].any()}
    return Model(table, idf, w[-1], rest, heat)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _sample_clauses(text: pd.Series) -> pd.Series:
    def some(t: str | None) -> list[list[str]]:
        found = [words for words, s, e in clauses(t or "") if e - s <= CLAUSE_CHARS]
        return found if len(found) <= CLAUSES_PER_ROW else [found[len(found) * i // CLAUSES_PER_ROW] for i in range(CLAUSES_PER_ROW)]

    return text.map(some)


def train_on(df: DataFrame, key: str, text: str, label: str, *, sample: int = SAMPLE_ROWS) -> Model:
    """Fit the model on a bounded sample of labelled rows.

    About ``sample`` rows are chosen by a hash of their key, and those with a label give at
    most ``CLAUSES_PER_ROW`` clauses each, so the sample has a fixed size however large the
    table. A table without any label gives a model without knowledge.
    """
    size = df.count()
    draw = (F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) + 0.5) / 1_000_003
    rows = df.filter(draw <= min(1.0, sample / max(1, size))).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), label_code(F.col(label)).alias("_lang"))
    chosen = rows.filter(F.col("_lang").isin(LANGUAGES)).select("_key", "_lang", F.explode(_sample_clauses("_text")).alias("_words"))
    got = sorted((r["_key"], r["_lang"], r["_words"]) for r in chosen.limit(2 * sample * CLAUSES_PER_ROW).collect())
    return train([(words, k) for _, k, words in got]) if got else Model({}, {}, np.zeros(len(LANGUAGES)), 1.0, 1.0)


def with_segments(df: DataFrame, text: str, model: Model, name: str = "segments") -> DataFrame:
    """Add ``name``: array of (language, confidence, start, end), one for each stretch of one language.

    Offsets count characters of the whole text. Null texts, empty texts and texts without a
    clause (interjections, sound notes, labels, names, figures) give an empty array.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SEGMENT)
    def segments(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.segments(texts.tolist()), dtype=object)

    # Declared nondeterministic so that Catalyst evaluates it once, not again in filters on its result.
    return df.withColumn(name, segments.asNondeterministic()(F.col(text)))


def wholly_in(df: DataFrame, text: str, model: Model, language: str) -> DataFrame:
    """Rows whose text has stretches of ``language`` alone, by the same rules as ``with_segments``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def wholly(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.wholly(texts.tolist(), language), dtype=bool)

    return df.filter(wholly(F.col(text)))


def mislabelled(df: DataFrame, label: str, segments: str = "segments") -> DataFrame:
    """Rows whose label is missing or names no language of the text, and rows in several languages; one row for each language.

    Adds ``language``; rows without a segment are never among them.
    """
    found = df.withColumn("_said", F.array_distinct(F.transform(segments, lambda s: s["language"]))).withColumn("_label", label_code(F.col(label)))
    wrong = F.col("_label").isNull() | ~F.array_contains("_said", F.col("_label")) | (F.size("_said") >= 2)
    return found.filter((F.size("_said") >= 1) & wrong).withColumn("language", F.explode("_said")).drop("_said", "_label")
