"""The operators for training data: brute force, exact round trips, held-out accuracy, defined cases."""

import os
import random
import unicodedata
from collections import defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from framelode.llm import ftrl
from framelode.llm.languages import LANGUAGES, Model, clauses, label_code, mislabelled, train, with_segments
from framelode.llm.lookalike import canonical, canonical_text, look_alike_classes, look_alike_pairs
from framelode.llm.mixing import mixed, water_fill
from framelode.llm.nearest import nearest_within
from framelode.llm.packing import fill_report, pack, packed
from framelode.llm.queries import reg
from framelode.llm.reading import fit_levels, word_counts
from framelode.llm.repeats import repeated_runs
from framelode.llm.spoken import same_words, words_said
from framelode.llm.tokens import RANKS, TOKENIZER_DIR, encoder, with_tokens
from framelode.llm.turns import Roster, clean_turns, isotonic, repaired_times, speaker_turns


@pytest.mark.parametrize("name", sorted(reg.queries))
def test_query(name, spark, sf, con):
    df = reg.queries[name](spark, sf)
    if name in reg.sql:
        assert oracle.compare(df, con, reg.sql[name]) is None
    else:
        assert df.columns and df.count() >= 0


# 1 repeats


def same(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(same_words(words_said(F.col("a")), words_said(F.col("b")))).first()[0]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("Look at the market!", "look at the  maket", True),
        ("One more bowl", "one more more bowl", True),
        ("[00:09] I think so, uh, yes", "I think so yes", True),
        ("the moss garden", "the moss gardden", True),
        ("turn left now", "turn right now", False),
        ("you can film here", "you can't film here", False),
        ("it is open today", "it is not open today", False),
        ("take exit 4 here", "take exit 14 here", False),
        ("여기는 촬영해도 되는 곳이래", "여기는 촬영하면 안 되는 곳이래", False),
        ("왼쪽으로 꺾으면", "오른쪽으로 꺾으면", False),
        ("음, 그 케이블카까지", "케이블카까지", True),
        ("[music]", "(music)", True),
        ("[music]", "[applause]", False),
        ("♪", "[music]", False),
    ],
)
def test_same_words(spark, a, b, want):
    assert same(spark, a, b) is want


def test_runs_against_brute_force(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for k in ("hot", "x", "y"):
        t, seq = 0.0, []
        for i in range(400 if k == "hot" else 40):
            t += rnd.choice([0.5, 3.0, 700.0])
            text = rnd.choice(["alpha beta", "gamma delta", "   ", "alpha beta."])
            rows.append((k, "l", t, t + 1 if i % 7 else None, f"{k}{i:04d}", text, 1))
            if text.strip():
                seq.append((f"{k}{i:04d}", text.strip(" .")))
        cur = []
        for s in [*seq, (None, None)]:
            if cur and cur[-1][1] == s[1]:
                cur.append(s)
            else:
                if len(cur) > 1:
                    want.add((k, cur[0][0], cur[-1][0], len(cur)))
                cur = [s]
    df = spark.createDataFrame(rows + rows[:50] + [(None, "l", 1.0, 2.0, "n", "alpha beta", 1), ("x", "l", None, 2.0, "m", "alpha beta", 1)], "k string, l string, s double, e double, id string, t string, _b int")
    got = {(r["k"], r["first_id"], r["last_id"], r["records"]) for r in repeated_runs(df, ["k", "l"], "s", "e", "id", "t").collect()}
    assert got == want
    assert repeated_runs(df.limit(0), ["k", "l"], "s", "e", "id", "t").count() == 0


def test_a_long_run_takes_few_rounds(spark):
    df = spark.range(700).select(F.lit("k").alias("k"), F.lit("l").alias("l"), F.col("id").cast("double").alias("s"), (F.col("id") + 0.5).alias("e"), F.format_string("%05d", "id").alias("id"), F.lit("same words").alias("t"))
    r = repeated_runs(df, ["k", "l"], "s", "e", "id", "t").collect()
    assert [(x["first_id"], x["last_id"], x["records"], x["seconds"]) for x in r] == [("00000", "00699", 700, 699.5)]


# 2 languages

SENTENCES = {
    "en": ["the driver said we would leave before {}", "there is a small bridge behind the {} station", "nobody wanted to wait for the {} in the rain"],
    "de": ["der Fahrer hat gesagt, dass wir vor {} weiterfahren", "hinter dem Bahnhof {} gibt es eine kleine Brücke", "niemand wollte im Regen auf {} warten"],
    "fr": ["le chauffeur a dit qu'on partirait avant {}", "il y a un petit pont derrière la gare de {}", "personne ne voulait attendre {} sous la pluie"],
    "es": ["el conductor dijo que saldríamos antes de {}", "hay un puente pequeño detrás de la estación {}", "nadie quería esperar a {} bajo la lluvia"],
    "pt": ["o motorista disse que a gente ia sair antes de {}", "tem uma ponte pequena atrás da estação {}", "ninguém queria esperar por {} na chuva"],
    "ko": ["기사님이 {} 전에 다시 출발한다고 하셨어", "{} 역 뒤에 작은 다리가 하나 있어", "비가 오는데 {} 기다리고 싶은 사람은 없었어"],
    "ja": ["運転手さんは{}の前に出発すると言っていました", "{}駅のうしろに小さな橋があります", "雨の中で{}を待ちたい人はいませんでした"],
}
NAMES = ["Aldor", "Brennt", "Corvik", "Dunmere", "Eskil", "Farrow", "Glint", "Hollis", "Ivrea", "Jorda"]


@pytest.fixture(scope="module")
def model() -> Model:
    rnd = random.Random(1)
    examples = []
    for k, lines in SENTENCES.items():
        for _ in range(150):
            words = clauses(rnd.choice(lines).format(rnd.choice(NAMES)))
            examples.append((words[0][0], k if rnd.random() > 0.1 else rnd.choice(LANGUAGES)))
    rnd.shuffle(examples)
    return train(examples)


def test_held_out_accuracy(model):
    good = total = 0
    for k, lines in SENTENCES.items():
        for line in lines:
            got = model.segments([line.format("Zelnik")])[0]
            total += 1
            good += [x[0] for x in got] == [k]
    assert good >= 0.95 * total


def test_wrong_labels_are_overruled_and_weights_sparse(model):
    weights = np.array(list(model.table.values()))
    assert (weights == 0).mean() > 0.3
    assert 0.3 <= model.heat <= 20


def test_mixed_texts_and_what_gives_no_language(model):
    text = "The driver said we would leave before Aldor, 기사님이 Corvik 전에 다시 출발한다고 하셨어. niemand wollte im Regen auf Farrow warten"
    assert [x[0] for x in model.segments([text])[0]] == ["en", "ko", "de"]
    both = "nobody wanted to wait for the bus in the rain niemand wollte im Regen auf den Bus warten"
    assert {x[0] for x in model.segments([both])[0]} == {"en", "de"}
    none = [None, "", "   ", "좋아", "oh no", "[music]", "(0:09) ♪ ♪", "Speaker 3:", "01:02:03 00:00:01", "ちょっと待って", "uh, um... er"]
    assert model.segments(none) == [[] for _ in none]


@pytest.mark.parametrize("order", [["en", "de", "en"], ["es", "en", "es"], ["en", "es", "de"], ["de", "en", "de", "en"]])
def test_a_clause_that_changes_language_several_times(model, order):
    lines = [SENTENCES[k][i % 3].replace(",", "").format("Aldor") for i, k in enumerate(order)]
    text = " ".join(lines)
    got = model.segments([text])[0]
    assert [x[0] for x in got] == order
    assert all(s1 < e1 <= s2 < e2 for (_, _, s1, e1), (_, _, s2, e2) in zip(got, got[1:])) and got[0][2] == 0 and got[-1][3] == len(text)


def test_offsets_point_into_the_text(model):
    text = "1\n00:00:00,000 --> 00:00:03,040\nthe driver said we would leave before Aldor.\n\n2\n00:00:03,040 --> 00:00:05,900\nderrière la gare il y a un petit pont."
    got = model.segments([text])[0]
    assert [text[s:e].split()[0] for _, _, s, e in got] == ["the", "derrière"]


def test_very_long_text(model):
    assert [x[0] for x in model.segments(["nobody wanted to wait for the bus in the rain. " * 20_000])[0]] == ["en"]


def test_labels(spark):
    rows = ["en", "en-US", "EN", "eng", " ko ", "ko_KR", "kor", "und", "unknown", "", None, "it-IT", "Deutsch"]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(label_code(F.col("x")))
    assert [r[0] for r in df.collect()] == ["en", "en", "en", "en", "ko", "ko", "ko", None, None, None, None, "it", "de"]


def test_mislabelled(spark, model):
    en, ko = SENTENCES["en"][0].format("Aldor"), SENTENCES["ko"][0].format("Aldor")
    rows = [("1", en, "en-GB"), ("2", en, "ko"), ("3", en, None), ("4", en + ". " + ko, "en"), ("5", "oh no", None), ("6", None, "en"), ("7", ko, "KOR")]
    df = with_segments(spark.createDataFrame(rows, "id string, text string, label string"), "text", model)
    assert {(r["id"], r["language"]) for r in mislabelled(df, "label").collect()} == {("2", "en"), ("3", "en"), ("4", "en"), ("4", "ko")}
    assert mislabelled(df.limit(0), "label").count() == 0


def test_regression_finds_sparse_weights():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 900)
    rows = [(np.array([k, *rng.integers(3, 60, 4)]), np.array([1.0, 0.3, 0.3, 0.3, 0.3])) for k in y]
    w = ftrl.fit(ftrl.Sparse(rows), y, 60, 3, epochs=4, l1=1.0)
    assert (ftrl.scores(w, ftrl.Sparse(rows)).argmax(1) == y).mean() > 0.98 and (w == 0).mean() > 0.3


# 3 turns

ROSTER = [("Guide", "Guide"), ("가이드", "Guide"), ("Host", "Host"), ("Speaker 1", "Speaker 1"), ("화자 1", "Speaker 1"), ("Speaker 3", "Speaker 3"), ("Camera A", "Camera A"), ("카메라 A", "Camera A")]


@pytest.mark.parametrize(
    "text, want",
    [
        (">> GUIDE: hello there", [("Guide", "hello there")]),
        ("[Spkr 1] you know... it took long (inaudible)", [("Speaker 1", "it took long")]),
        ("(SPEAKER_03) hi HOST – and bye", [("Speaker 3", "hi"), ("Host", "and bye")]),
        ("00:00:22.500 화자1：어 갔지", [("Speaker 1", "갔지")]),
        ("Giude: one. Hots: two", [("Guide", "one."), ("Host", "two")]),
        ("CAM A: x <cam-a> y S3: z", [("Camera A", "x"), ("Camera A", "y"), ("Speaker 3", "z")]),
        ("Remember: the guide said so", [(None, "Remember: the guide said so")]),
        ("[music]", []),
        ("uhm...", []),
        ("", []),
        (None, []),
    ],
)
def test_pieces(text, want):
    assert [(w, c) for w, c, n in Roster(ROSTER).pieces(text) if n] == want


def test_turns(spark):
    rows = [
        ("a", 0.0, "1", "before any label"), ("a", 1.0, "2", "Guide: one"), ("a", 2.0, "3", "[music]"), ("a", 3.0, "4", "two"), ("a", 700.0, "5", "three Host: four"), ("a", 701.0, "6", "uh"), ("a", 702.0, "7", "Guide:"), ("a", 703.0, "8", "five"),
        ("b", 0.0, "9", "no label here"), (None, 0.0, "0", "Guide: x"), ("a", 1.0, "2", "Guide: one"), ("c", 1.0, "1", None), ("c", None, "2", "Guide: x"),
    ]
    df = spark.createDataFrame(rows, "k string, s double, id string, t string").withColumns({"e": F.col("s"), "n": F.col("id").cast("long")})
    args = ("k", "s", "e", "id", "n", "t", ROSTER)
    for stated in (True, False):
        assert {tuple(r) for r in speaker_turns(df, *args, stated=stated).collect()} == {("a", "Guide", "2", "5"), ("a", "Host", "5", "5"), ("a", "Guide", "8", "8")}
    assert speaker_turns(df.limit(0), *args, stated=True).count() == 0


def test_turns_across_a_clock_reset(spark):
    rows = [("a", 100.0, "u0", 0, "Guide: one"), ("a", 110.0, "u1", 1, "two"), ("a", 5.0, "u2", 2, "three"), ("a", 15.0, "u3", 3, "Host: four")]
    df = spark.createDataFrame(rows, "k string, s double, id string, n long, t string").withColumn("e", F.col("s"))
    args = ("k", "s", "e", "id", "n", "t", ROSTER)
    assert {tuple(r) for r in speaker_turns(df, *args).collect()} == {("a", "Guide", "u0", "u2"), ("a", "Host", "u3", "u3")}
    assert {tuple(r) for r in speaker_turns(df, *args, stated=True).collect()} == {("a", "Host", "u3", "u3"), ("a", "Guide", "u0", "u1")}


def test_isotonic_is_the_least_squares_projection():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.normal(size=12)
        y = isotonic(x)
        assert (np.diff(y) >= -1e-12).all()
        for _ in range(50):
            z = np.sort(y + rng.normal(scale=0.1, size=12))
            assert ((x - y) ** 2).sum() <= ((x - z) ** 2).sum() + 1e-9


def test_clock_resets_and_noise(spark):
    starts = [0.0, 5.0, 4.6, 9.0, 100.0, 0.5, 3.0, 2.9, 8.0]
    rows = [("a", i, s, s + 1.0) for i, s in enumerate(starts)] + [("a", 9, None, 1.0), (None, 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, n long, s double, e double")
    got = [r["fixed_start"] for r in repaired_times(df, "k", "n", "s", "e", per_bucket=3).orderBy("n").collect()]
    want = [*isotonic(np.array(starts[:5])), *(isotonic(np.array(starts[5:])) + 101.0 - 0.5)]
    assert got == pytest.approx(want, abs=1e-5)


def test_clean_turns(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0, "1", 1, "Guide: uh, one"), ("a", 2.0, 1.0, "2", 2, "two [music]"), ("a", 4.0, 5.0, "3", 3, "Host: three")], "k string, s double, e double, id string, n long, t string")
    spans = spark.createDataFrame([("1", 0, 0.5), ("1", 1, 0.7), ("2", 0, None), ("3", 0, 0.9)], "utterance_id string, span_index int, confidence double")
    got = [(r["speaker"], r["text"], r["start"], r["end"], r["confidence"]) for r in clean_turns(df, spans, "k", "s", "e", "id", "n", "t", ROSTER).orderBy("start").collect()]
    assert got == [("Guide", "one two", 0.0, 2.0, 0.6), ("Host", "three", 4.0, 5.0, 0.9)]


def test_clean_turns_across_a_clock_reset(spark):
    rows = [
        ("a", 10.0, 12.0, "1", 1, "Guide: one"), ("a", 20.0, 22.0, "2", 2, "two"), ("a", 19.5, 21.0, "3", 3, "Host: three"), ("a", 30.0, 32.0, "4", 4, "four"),
        ("a", 1.0, 2.0, "5", 5, "five"), ("a", 15.0, 16.0, "6", 6, "Guide: six"), ("a", 25.0, 26.0, "7", 7, "seven"), ("a", 15.0, 16.0, "6", 6, "Guide: six"),
    ]
    df = spark.createDataFrame(rows, "k string, s double, e double, id string, n long, t string")
    spans = spark.createDataFrame([], "utterance_id string, span_index int, confidence double")
    got = [(r["speaker"], r["text"], r["start"], r["end"]) for r in clean_turns(df, spans, "k", "s", "e", "id", "n", "t", ROSTER).orderBy("start").collect()]
    assert got == [("Guide", "one two", 10.0, 21.75), ("Host", "three four five", 19.75, 33.0), ("Guide", "six seven", 46.0, 57.0)]
    unplaced = df.withColumn("n", F.lit(None).cast("long"))
    assert {r["text"] for r in clean_turns(unplaced, spans, "k", "s", "e", "id", "n", "t", ROSTER).collect()} == {"one six", "three two seven four"}


# 4 look-alikes


@pytest.mark.parametrize(
    "a, b, alike",
    [
        ("ＭＰ４", "MP4", True), ("Züri", "Züri", True), ("a b", "a b", True), ("a　b", "a b", True), ("a​b", "ab", True), ("Аsh", "Ash", True), ("ο", "o", True), ("ﾎﾃﾙ", "ホテル", True),
        ("호", "호", True), ("Ⅱ", "II", True), ("ﬁ", "fi", True), ("Å", "Å", True), ("a‑b", "a-b", True), ("ﾄﾞ", "ド", True),
        ("a", "A", False), ("e", "é", False), ("0", "O", False), ("x²", "x2", False), ("①", "1", False), ("a-b", "a_b", False), ("a–b", "a-b", False), ("3", "З", False), ("½", "1/2", False),
    ],
)
def test_what_looks_alike(a, b, alike):
    assert (canonical(a) == canonical(b)) is alike


def test_compatibility_ideographs_beyond_the_first_planes(spark):
    df = spark.createDataFrame([("1", "\U0002f800x"), ("2", "\u4e3dx"), ("3", "\u4e3cx")], "id string, n string")
    assert {tuple(r) for r in look_alike_pairs(df, "id", ["n"]).collect()} == {("1", "2")}
    assert [r["c"] for r in canonical_text(df, "n", "c").orderBy("id").collect()] == ["\u4e3dx", "\u4e3dx", "\u4e3cx"]


def test_segments_equal_whole_texts(spark):
    rnd = random.Random(9)
    pool = "abcZ 09-_.ＡＢ１é́̈оАﾎﾃﾄﾞ혼호​­Ⅱﬁ　 漢字ホ\n"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 30))) for _ in range(400)] + ["́x", "", "x" * 100_000 + "é"]
    got = {r["t"]: r["c"] for r in canonical_text(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), "t", "c").collect()}
    assert got.pop(None) is None
    for t in texts:
        assert got[t] == canonical(t), ascii(t)
        assert canonical(got[t]) == got[t]


def test_every_code_point(spark):
    """Of all planes, between letters and after a letter that marks can join."""
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{chr(c)}e" for c in codes[i : i + 512]) for i in range(0, len(codes), 512)]
    got = {r["t"]: r["c"] for r in canonical_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "c").collect()}
    assert not [i for i, t in enumerate(texts) if got[t] != canonical(t)]


def test_classes_and_their_links(spark):
    rows = [("1", "MVI 1"), ("2", "MVI 1"), ("3", "ＭVI 1"), ("4", "other"), (None, "ＭVI 1"), ("5", None), ("3", "ＭVI 1")]
    got = {tuple(r) for r in look_alike_classes(spark.createDataFrame(rows, "id string, n string"), "id", ["n"]).collect()}
    assert got == {("n", "MVI 1", "MVI 1", 2, 1), ("n", "MVI 1", "ＭVI 1", 1, 2)}


def test_pairs_against_brute_force(spark):
    rows = [(f"{i:03d}", rnd_name) for i, rnd_name in enumerate(["MVI 1", "MVI 1", "ＭVI 1", "mvi 1", "MVI 1"] * 8 + [None, "x"])]
    df = spark.createDataFrame([(a, n, n) for a, n in rows] + [("000", "MVI 1", "MVI 1"), (None, "MVI 1", None)], "id string, n string, p string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and canonical(x) == canonical(y)}
    assert {tuple(r) for r in look_alike_pairs(df, "id", ["n", "p"]).collect()} == want
    assert unicodedata.normalize("NFC", "é") == canonical("é")


# 5 nearest


def test_nearest_against_brute_force(spark):
    rnd = random.Random(8)
    right = [("h" if rnd.random() < 0.5 else "x", round(rnd.random() * 60, 3), i) for i in range(300)]
    left = [("h" if rnd.random() < 0.5 else "x", round(rnd.random() * 60, 3), i) for i in range(300)] + [("h", 30.0, 900), ("h", 30.0, 900), (None, 1.0, 901), ("h", None, 902), ("h", float("nan"), 903), ("zz", 1.0, 904), ("h", -0.1, 905)]
    right += [("h", 30.4, 5000), ("h", 29.6, 5001), ("h", None, 1), (None, 1.0, 2), ("h", -0.3, 5002)]
    us = lambda t: round(t * 1_000_000)
    want = set()
    for k, t, i in left:
        if k is None or t is None or t != t:
            continue
        near = sorted((abs(us(t) - us(u)), us(u), j) for c, u, j in right if c == k and u is not None and abs(us(t) - us(u)) <= 400_000)
        if near:
            want.add((i, near[0][2]))
    lf = spark.createDataFrame(left, "k string, t double, i long")
    rt = spark.createDataFrame(right, "k string, t double, j long")
    for cell in (1, 5):
        assert {tuple(r) for r in nearest_within(lf, rt, ["k"], "t", ["i"], "t", "j", 0.4, cell=cell).collect()} == want
    assert nearest_within(lf, rt.limit(0), ["k"], "t", ["i"], "t", "j", 0.4).count() == 0


# 8 packing


def test_packing_never_overfills_and_is_tight():
    rnd = random.Random(3)
    for cap in (64, 512, 4096):
        sizes = [min(cap - 1, int(rnd.expovariate(1 / 90)) + rnd.randrange(0, 3)) for _ in range(3000)]
        fill = defaultdict(int)
        for n, c in zip(sizes, pack(sizes, cap)):
            fill[c] += n
        assert max(fill.values()) <= cap and sum(sizes) / (len(fill) * cap) > 0.93
    assert pack([], 10) == [] and len(set(pack([0, 0, 5], 10))) == 1


def test_every_token_is_placed_once(spark):
    rows = [(i, n) for i, n in enumerate([0, 1, 10, 11, 25, 30, 7, 7, 3, None])] + [(2, 10), (None, 4)]
    df = packed(spark.createDataFrame(rows, "id long, n long"), "id", "n", [("a", 10), ("b", 30)])
    got = df.collect()
    for kind, cap in (("a", 10), ("b", 30)):
        mine = [r for r in got if r["container_kind"] == kind]
        assert {r["id"] for r in mine} == set(range(10))
        fill = defaultdict(int)
        for r in mine:
            fill[r["container"]] += r["tokens"]
        assert max(fill.values()) <= cap
        for i, n in dict(rows[:10]).items():
            parts = sorted((r["from_token"], r["tokens"]) for r in mine if r["id"] == i)
            assert sum(t for _, t in parts) == (n or 0) and (len(parts) == 1 or n > cap)
            assert [a for a, _ in parts] == [k * cap for k in range(len(parts))]
    assert fill_report(df, [("a", 10), ("b", 30)]).count() == 2
    assert packed(spark.createDataFrame([], "id long, n long"), "id", "n", [("a", 10)]).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/{RANKS}"), reason="no vocabulary files here")
def test_tokens_round_trip(spark):
    texts = ["hello world", "국물이 맛있다", "", "a" * 5000, "tabs\tand\n lines  "]
    e = encoder(f"{TOKENIZER_DIR}/{RANKS}")
    got = [r[0] for r in with_tokens(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), "t").select("tokens").collect()]
    assert got == [len(e.encode_ordinary(t)) for t in texts] + [0]
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts)


# 9 mixing


def test_water_filling():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, 200) == {"a": 100, "b": 100}
    got = water_fill({"a": 10, "b": 100, "c": 100}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 2, "b": 4, "c": 4}, 200)
    assert got == {"a": 20, "b": 90, "c": 90}
    assert water_fill({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 9}, 1000) == {"a": 20, "b": 0.0}


def test_draws(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaaaaabbc"), rnd.randrange(1, 200)) for i in range(4000)] + [(9000, "z", 50), (9001, None, 50), (9002, "a", 0), (9003, "a", None)]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    items = spark.createDataFrame(rows + rows[:100], "id long, source string, n long")
    draws, shares = mixed(items, targets, "id", "source", "n")
    got = draws.collect()
    caps = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in got) and len({r["id"] for r in got}) == len(got)
    report = {r["source"]: r for r in shares.collect()}
    assert report["none"]["drawn"] == 0 and sum(r["actual_share"] for r in report.values()) == pytest.approx(1, abs=1e-5)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    want = water_fill({k: sizes[k] for k in caps}, {"a": 0.2, "b": 0.4, "c": 0.3, "none": 0.1}, {**caps, "none": 5}, sum(sizes[k] for k in caps))
    for k in caps:
        assert abs(report[k]["drawn"] - want[k]) <= 200, (k, report[k]["drawn"], want[k])
    again = {tuple(r) for r in mixed(items, targets, "id", "source", "n")[0].collect()}
    assert again == {tuple(r) for r in got}
    assert {tuple(r) for r in mixed(items, targets, "id", "source", "n", seed=8)[0].collect()} != again


# 10 reading level


def levels(spark, docs, grades, **kw):
    counts = word_counts(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    return {r["_d"]: (r["theta"], r["level"]) for r in fit_levels(counts, spark.createDataFrame(grades, "id long, grade int"), "id", "grade", **kw).collect()}


def test_levels_are_recovered(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}" for a in "bcdfghjklmnp" for b in ("ano", "elu", "iro", "osk", "uma")])
    hard = np.linspace(-2, 2, len(words))
    truth = rng.normal(size=150)
    docs, grades = [], []
    for i, t in enumerate(truth):
        p = np.exp(hard * t)
        docs.append((i, " ".join(rng.choice(words, 120, p=p / p.sum()))))
        if i % 3 == 0:
            grades += [(i, int(round(9 + 3 * t))), (i, int(round(9 + 3 * t + rng.normal())))]
    grades += [(3, 17), (6, None), (99999, 5)]
    docs += [(1000, ""), (1001, None), (0, docs[0][1])]
    by_map = levels(spark, docs, grades)
    got = np.array([by_map[i][1] for i in range(150)])
    # The latent scale is free up to its shape, so order is what must be recovered.
    rank = lambda x: np.argsort(np.argsort(x))
    assert np.corrcoef(rank(got), rank(truth))[0, 1] > 0.98 and np.abs(got - (9 + 3 * truth)).mean() < 1
    assert by_map[1000][1] is None and by_map[1001][1] is None
    # However many words are sent to the workers, the levels are the same; so are they among documents without words.
    for sent in (0, 20):
        by_join = levels(spark, docs + [(2000 + i, " . ") for i in range(240)], grades, sent_words=sent)
        assert all(by_join[i] == pytest.approx(by_map[i], abs=1e-6) for i in range(150)) and by_join[2000] == (0.0, None)


def test_no_grades(spark):
    assert levels(spark, [(1, "a b c")], [(1, None)]) == {1: (0.0, None)}


def test_documents_without_words_move_no_levels(spark):
    docs = [(i, " ".join(["easy"] * (9 - i) + ["hard"] * (i + 1) + ["the"] * 5)) for i in range(9)]
    grades = [(i, 2 + i) for i in range(9)]
    empty = [(100 + i, "") for i in range(40)]
    want = levels(spark, docs, grades, rounds=2)
    got = levels(spark, docs + empty, grades, rounds=2, sent_words=0)
    assert all(got[i] == pytest.approx(want[i], abs=1e-3) for i in range(9)) and got[100][1] is None
