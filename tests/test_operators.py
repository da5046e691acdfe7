"""Operators on small fixtures, with the values the rules ask for and against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from framelode.functions import scalar as S
from framelode.operators import constraints as C
from framelode.operators import edits as E
from framelode.operators import intervals as I
from framelode.operators import ordered as O
from framelode.operators import selection as L
from framelode.operators.sequence import with_last_known, with_next, with_previous, with_running_max
from framelode.sources import readers as R
from framelode.sources import sinks as K
from framelode.streaming import jobs as J


def values(spark, *exprs):
    return list(spark.range(1).select(*exprs).first())


def test_timecodes(spark):
    assert values(spark, *(S.timecode(F.lit(x)) for x in (0.0, 65.432, 3661.2, -1.0))) == ["00:00.000", "01:05.432", "01:01:01.200", "00:00.000"]
    assert values(spark, S.timecode(F.lit(None).cast("double"))) == [None]


def test_tempo(spark):
    got = values(spark, *(S.tempo_steps(F.lit(x)) for x in (0.25, 8.0, 3.0, 1.0, 0.0)))
    assert got == [[0.5, 0.5], [2.0, 2.0, 2.0], [2.0, 1.5], [1.0], None]


def test_rationals_and_hashes(spark):
    got = values(spark, S.rational(F.lit("30000/1001")), S.rational(F.lit("0/0")), S.rational(F.lit("x")), S.hamming64(F.lit("f" * 16), F.lit("0" * 16)), S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert got[0] == pytest.approx(29.97, abs=1e-2) and got[1:] == [None, None, 1.0, 1.0]


def test_look_back_against_plain_windows(spark):
    rnd = random.Random(1)
    rows = [("a" if rnd.random() < 0.5 else "b", rnd.randrange(1000), i, rnd.choice([None, rnd.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long").withColumn("_b", F.floor(F.col("t") / 37).cast("long"))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "i")
    x = with_running_max(with_last_known(with_next(with_previous(df, ["k"], "_b", ["t", "i"], ["i"], "p"), ["k"], "_b", ["t", "i"], ["i"], "n"), ["k"], "_b", ["t", "i"], "v", "l"), ["k"], "_b", ["t", "i"], "v", "m")
    got = {r["i"]: (r["p"] and r["p"]["i"], r["n"] and r["n"]["i"], r["l"], r["m"]) for r in x.collect()}
    y = df.select("i", F.lag("i").over(w), F.lead("i").over(w), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    assert got == {r[0]: tuple(r)[1:] for r in y.collect()}


def test_suppression_is_inclusive_or_strict(spark):
    df = spark.createDataFrame([("a", 0.0, 0.9, "1"), ("a", 1.0, 0.8, "2"), ("a", 2.0, 0.7, "3"), ("a", None, 0.9, "4")], "k string, t double, c double, id string")
    assert [r["id"] for r in O.suppress(df, ["k"], "t", "c", "id", 1.0).orderBy("t").collect()] == ["1", "3"]
    assert [r["id"] for r in O.suppress(df, ["k"], "t", "c", "id", 1.0, inclusive=False).orderBy("t").collect()] == ["1", "2", "3"]
    assert O.suppress(df.limit(0), ["k"], "t", "c", "id", 1.0).count() == 0


def test_suppression_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [("h" if rnd.random() < 0.6 else "x", round(rnd.random() * 200, 1), round(rnd.random(), 1), f"{i:03d}") for i in range(300)]
    want = set()
    for k in "hx":
        kept = []
        for _, t, c, i in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1], r[3])):
            if all(abs(t - x) > 2 for x, _ in kept):
                kept.append((t, i))
        want |= {i for _, i in kept}
    assert {r["id"] for r in O.suppress(spark.createDataFrame(rows, "k string, t double, c double, id string"), ["k"], "t", "c", "id", 2.0).collect()} == want


def test_clusters_keep_opposed_speech_apart(spark):
    df = spark.createDataFrame([("a", 4.20, "visual_change", 0.7, "V1"), ("a", 4.25, "hard_cut", 0.8, "F1"), ("a", 7.00, "speech_start", 0.8, "S1"), ("a", 7.25, "speech_end", 0.8, "S2")], "asset_id string, timestamp double, kind string, confidence double, source_id string")
    got = O.fused_proposals(df, ["asset_id"], 0.55).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["primary_kind"]) for r in got] == [(4.25, "hard_cut"), (7.0, "speech_start"), (7.25, "speech_end")]


def test_times_taken_move_to_the_next_free_one(spark):
    rnd = random.Random(3)
    rows = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.001), ("a", 4, 5.0015), ("a", 5, 5.0015), ("a", 6, 5.004)]
    for k in "bc":
        times = sorted(round(rnd.randrange(60) / 1000 + rnd.choice([0, 0.0005]), 4) for _ in range(80))
        rows += [(k, i, t) for i, t in enumerate(times)]
    got = {(r["k"], r["n"]): r["t"] for r in O.moved_apart(spark.createDataFrame(rows, "k string, n long, t double"), ["k"], "t", "n").collect()}
    used = set()
    for k, n, t in rows:
        while (k, t) in used:
            t = round(t + 0.001, 6)
        used.add((k, t))
        assert got[k, n] == t, (k, n)


def _greedy(rows, tol, inclusive=True):
    want, kept = set(), {}
    for k, t, c, i in sorted(rows, key=lambda r: (-(r[2] if r[2] is not None else float("-inf")), r[1], r[3])):
        if all(abs(t - x) > tol if inclusive else abs(t - x) >= tol for x in kept.setdefault(k, [])):
            kept[k].append(t)
            want.add((k, i))
    return want


def test_suppression_across_buckets(spark):
    """Chains of equal and of falling scores that reach over many buckets, and noise."""
    rnd = random.Random(6)
    rows = [("equal", i * 5.0, 0.5, i) for i in range(600)] + [("falling", i * 5.0, 1 - i / 1000, i) for i in range(600)] + [("rising", i * 5.0, i / 1000, i) for i in range(600)]
    rows += [("noise", round(rnd.random() * 3000, 1), round(rnd.random(), 2), i) for i in range(600)] + [("null", i * 10.0, None, i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, t double, c double, id long")
    for inclusive in (True, False):
        got = {(r["k"], r["id"]) for r in O.suppress(df, ["k"], "t", "c", "id", 10.0, inclusive=inclusive).collect()}
        assert got == _greedy(rows, 10.0, inclusive)


def test_chains_across_buckets(spark):
    from framelode.operators.chains import chained, first_beyond

    rnd = random.Random(8)
    rows = [(k, round(t, 2), i) for k, step in (("dense", 0.3), ("sparse", 9.0), ("gaps", 40.0)) for i, t in enumerate(sorted(rnd.random() * step * 300 for _ in range(300)))]
    got = {}
    for r in chained(spark.createDataFrame(rows, "k string, t double, id int"), ["k"], "t", "id", [], 2.0, lambda t: first_beyond(t, 2.0), width=10.0).collect():
        got.setdefault(r["k"], []).append((r["t"], r["id"], tuple(r["segment"]), r["starts"]))
    for k in ("dense", "sparse", "gaps"):
        anchor, segment, seen = None, None, set()
        assert len(got[k]) == 300
        for t, _, seg, starts in sorted(got[k]):
            new = anchor is None or t - anchor > 2.0
            assert starts == new
            if new:
                anchor, segment = t, seg
                assert seg not in seen
                seen.add(seg)
            assert seg == segment


def test_groups_end_at_hard_changes_and_spans(spark):
    rows = [("a", f"S{i}", 5.0 * i, 5.0 * i + 5, h, r) for i, (h, r) in enumerate([("0" * 16, False), ("0" * 16, True), ("f" * 16, False), ("f" * 16, True), ("0" * 16, True), (None, True)])]
    df = spark.createDataFrame(rows, "k string, id string, s double, e double, h string, hard boolean")
    assert [r["group"] for r in L.adjacent_groups(df, "k", "id", "s", "e", "h", "hard").orderBy("id").collect()] == ["S0"] * 4 + ["S4"] * 2
    assert [r["group"] for r in L.adjacent_groups(df, "k", "id", "s", "e", "h", "hard", longest=12.0).orderBy("id").collect()] == ["S0", "S0", "S2", "S2", "S4", "S4"]


def test_adaptive_segments_drop_the_short_tail(spark):
    rows = [("a", float(5 * i), c, 27.0) for i, c in enumerate([0.0, 0.05, 0.30, 0.05, 0.05, 0.05])]
    got = O.adaptive_segments(spark.createDataFrame(rows, "k string, t double, c double, d double"), "k", "t", "c", "d", shortest=5.0, longest=15.0, threshold=0.2).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0.0, 10.0), (10.0, 27.0)]


def test_complement_and_split(spark):
    s = spark.createDataFrame([("a", 5.0, 8.0), ("a", 18.0, 20.0)], "k string, s double, e double")
    d = spark.createDataFrame([("a", 40.0)], "k string, d double")
    got = I.split_evenly(I.complement(s, d, "k", "s", "e", "d"), "s", "e", 10.0).orderBy("s").collect()
    assert [(r["s"], r["e"]) for r in got] == [(0.0, 5.0), (8.0, 18.0), (20.0, 30.0), (30.0, 40.0)]


def test_overlap_is_half_open(spark):
    a = spark.createDataFrame([("k", 1, 0.0, 60.0), ("k", 2, 60.0, 200.0)], "k string, i int, s double, e double")
    b = spark.createDataFrame([("k", 9, 60.0, 130.0)], "k string, j int, bs double, be double")
    assert {(r["i"], r["j"]) for r in I.overlap_join(a, b, "k", ("s", "e"), ("bs", "be")).collect()} == {(2, 9)}
    assert I.overlap_join(a, b, "k", ("s", "e"), ("bs", "be"), how="left_anti").count() == 1


def test_duplicates_look_at_the_last_accepted(spark):
    rows = [("k", 1, 0.0, 1.0, "hi", []), ("k", 2, 1.5, 2.0, "hi", []), ("k", 3, 2.5, 3.0, "ho", ["empty"]), ("k", 4, 2.6, 3.0, "hi", []), ("k", 5, 9.0, 9.5, "hi", [])]
    df = spark.createDataFrame(rows, "k string, i int, s double, e double, n string, r array<string>")
    got = {r["i"]: r["all_reasons"] for r in O.accepted_speech(df, "k", "i", "s", "e", "n", "r").collect()}
    assert got == {1: [], 2: ["duplicate_phrase"], 3: ["empty"], 4: ["duplicate_phrase"], 5: []}


def test_windows_never_cut_evidence(spark):
    rnd = random.Random(4)
    cases = {}
    for k in range(60):
        ev = sorted((a := rnd.random() * 40, a + rnd.random() * 6) for _ in range(rnd.randrange(1, 15)))
        cases[k] = (min(a for a, _ in ev), max(b for _, b in ev), ev)
    st = spark.createDataFrame([(k, s, e) for k, (s, e, _) in cases.items()], "k int, s double, e double")
    pc = spark.createDataFrame([(k, *x) for k, c in cases.items() for x in c[2]], "k int, xs double, xe double")
    rows = L.speech_windows(st, pc, "k").orderBy("k", "window").collect()
    for k, (start, end, ev) in cases.items():
        out = [(r["start"], r["end"]) for r in rows if r["k"] == k]
        assert out[0][0] == round(start, 3) and out[-1][1] == round(end, 3) and all(x[1] == y[0] for x, y in zip(out, out[1:]))
        for a, cut in out[:-1]:
            assert not any(x + 0.002 < cut < y - 0.002 for x, y in ev), (k, cut)
            assert end - cut >= 0.998


def test_windows_take_the_nearest_end_or_the_aim(spark):
    st = spark.createDataFrame([("a", 0.0, 30.0), ("b", 0.0, 25.0), ("c", 0.0, 8.5)], "k string, s double, e double")
    pc = spark.createDataFrame([("a", 0.0, 5.0), ("a", 6.0, 9.5), ("a", 9.0, 30.0), ("b", 0.0, 1.0), ("b", 24.0, 25.0), ("c", 0.0, 8.0), ("c", 8.0, 8.5)], "k string, xs double, xe double")
    got = {(r["k"], r["start"], r["end"]) for r in L.speech_windows(st, pc, "k").collect()}
    assert got == {("a", 0.0, 5.0), ("a", 5.0, 30.0), ("b", 0.0, 8.0), ("b", 8.0, 16.0), ("b", 16.0, 24.0), ("b", 24.0, 25.0), ("c", 0.0, 8.5)}


def test_captions(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0, "one two three four five six"), ("b", 0.0, 1.0, "  "), ("c", 0.0, 1.0, None)], "id string, s double, e double, t string")
    got = L.split_captions(df, "id", "s", "e", "t", width=12).orderBy("piece").collect()
    assert [r["text"] for r in got] == ["one two", "three four", "five six"] and got[-1]["piece_end"] == 10.0 and got[0]["piece_end"] == pytest.approx(10 * 7 / 25)


def test_storyboard_takes_all_of_few(spark):
    rows = [("g", float(i), 0.5 + (i == 3) * 0.4, "0" * 16, i, 0.0, 20.0) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, t double, q double, h string, id int, start double, end double")
    got = [r["id"] for r in L.storyboard(df, ["g"], "t", "q", "h", "id", most=4).orderBy("place").collect()]
    assert len(got) == 4 and 3 in got and {0, 11} <= set(got)
    assert L.storyboard(df.limit(2), ["g"], "t", "q", "h", "id", most=4).count() == 2


def test_edits(spark, tmp_path):
    clips = "array<struct<id:string,source_in:double,source_out:double,speed:double>>"
    df = spark.sql(f"SELECT 'e' AS edit_id, 1 AS sequence, 'r1' AS revision_id, CAST(array(named_struct('id','a','source_in',1.0D,'source_out',7.5D,'speed',1.0D), named_struct('id','b','source_in',0.0D,'source_out',2.0D,'speed',2.0D)) AS {clips}) AS clips")
    r = df.select(E.duration(F.col("clips")), E.move_clip(F.col("clips"), "a", 1), E.trim_clip(F.col("clips"), "b", 0.5, 1.0), E.remove_clip(F.col("clips"), "a")).first()
    assert r[0] == 7.5 and [c["id"] for c in r[1]] == ["b", "a"] and r[2][1]["source_in"] == 0.5 and len(r[3]) == 1
    path = str(tmp_path / "rev")
    E.commit(spark, path, "e", None, df)
    with pytest.raises(E.StaleHead):
        E.commit(spark, path, "e", None, df)
    E.commit(spark, path, "e", "r1", df.withColumns({"sequence": F.lit(2), "revision_id": F.lit("r2")}))
    assert E.heads(spark.read.parquet(path)).first()["revision_id"] == "r2" and E.history(spark.read.parquet(path), "e").count() == 2


def test_edit_operations(spark, tmp_path):
    path = str(tmp_path / "edits")
    scenes = spark.createDataFrame([("s1", "A", 0.0, 12.0, "one"), ("s2", "B", 3.0, 9.0, "two")], "scene_id string, asset_id string, source_in double, source_out double, title string")
    with pytest.raises(KeyError):
        E.get_edit(spark, path, "e")
    first = E.create_edit(spark, path, "e", "Trip", brief="b", target_duration=30)
    with pytest.raises(E.StaleHead):
        E.create_edit(spark, path, "e", "Trip")
    do = lambda head, *ops: E.apply_operations(spark, path, scenes, "e", head, "change", list(ops))
    two = do(first["revision_id"], {"op": "add_scene", "scene_id": "s1", "source_in": 1}, {"op": "add_scene", "scene_id": "s2"}, {"op": "set_title", "title": " Day "}, {"op": "set_target_duration", "target_duration": 60})
    assert (two["sequence"], two["title"], two["target_duration"], two["clip_count"], two["timeline_duration"]) == (2, "Day", 60.0, 2, 17.0)
    ids = [c["id"] for c in two["clips"]]
    three = do(two["revision_id"], {"op": "move_clip", "clip_id": ids[0], "to_index": 1}, {"op": "trim_clip", "clip_id": ids[1], "source_out": 5.0})
    assert [c["id"] for c in three["clips"]] == ids[::-1] and three["clips"][0]["source_out"] == 5.0
    head = three["revision_id"]
    with pytest.raises(E.StaleHead):
        do(two["revision_id"], {"op": "remove_clip", "clip_id": ids[0]})
    bad = [{"op": "trim_clip", "clip_id": ids[1], "source_in": 1.0}, {"op": "set_title", "title": " "}, {"op": "set_target_duration", "target_duration": 4}, {"op": "move_clip", "clip_id": ids[0], "to_index": 2}, {"op": "fly"}]
    for op in bad:
        with pytest.raises(ValueError):
            do(head, {"op": "set_title", "title": "never kept"}, op)
    for op in ({"op": "remove_clip", "clip_id": "x"}, {"op": "add_scene", "scene_id": "s9"}):
        with pytest.raises(KeyError):
            do(head, op)
    with pytest.raises(ValueError):
        do(head, *[{"op": "set_title", "title": "x"}] * 101)
    assert E.get_edit(spark, path, "e")["title"] == "Day"
    four = do(head, {"op": "remove_clip", "clip_id": ids[0]})
    assert four["clip_count"] == 1 and E.history(spark.read.parquet(path), "e").count() == 4


def test_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "rev")
    df = spark.sql("SELECT 'e' AS edit_id, 1 AS sequence, 'r1' AS revision_id")
    from pathlib import Path as P

    mark = P(path) / "_claims" / f"{E.slug_of('e')}-1"
    mark.parent.mkdir(parents=True)
    mark.write_text("")
    with pytest.raises(E.StaleHead):
        E.commit(spark, path, "e", None, df)
    mark.unlink()
    E.commit(spark, path, "e", None, df)
    assert mark.exists()


def test_documents_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "doc")
    for n in (3, 5):
        K.write_document(spark.range(n), path)
        assert spark.read.json(path).count() == n
    broken = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        K.write_document(broken, path)
    assert spark.read.json(path).count() == 5 and not (tmp_path / "doc.old").exists()


def test_due_jobs_and_stage_chains(spark):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    ev = spark.createDataFrame([("CLIP", at(1), "started"), ("CLIP", at(2), "completed"), ("WAIT", at(1), "completed"), ("WAIT", at(2), "started"), ("OLD", at(1), "failed"), ("NEW", at(50), "failed")], "k string, t timestamp, e string")
    jobs = spark.createDataFrame([(x,) for x in ("CLIP", "WAIT", "OLD", "NEW", "FRESH", None)], "k string")
    assert {r["k"] for r in J.due(jobs, ev, "k", "t", "e", at(59), seconds=30).collect()} == {"WAIT", "OLD", "FRESH"}
    st = spark.createDataFrame([("a", 1, "reused"), ("a", 2, "completed"), ("a", 3, "reused"), ("b", 1, "failed"), ("b", 2, "completed"), ("c", 1, "reused"), ("c", 2, "reused"), ("d", 1, "completed"), ("d", 2, "awaiting_review"), ("d", 3, "completed")], "a string, n int, s string")
    x = J.stage_chain(st, "a", "n", "s")
    assert {(r["a"], r["n"]): r["effective"] for r in x.collect() if r["effective"] != r["s"]} == {("a", 3): "completed", ("b", 2): "blocked", ("d", 3): "blocked"}
    assert {r["a"]: r["status"] for r in J.stage_status(x, "a", "effective").collect()} == {"a": "completed", "b": "failed", "c": "reused", "d": "awaiting_review"}


def test_a_cluster_names_its_checkpoint_folder():
    from types import SimpleNamespace

    from framelode.session import ensure_checkpoint_dir

    none = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://m:7077", getCheckpointDir=lambda: None, getConf=lambda: none), conf=none)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_functions_in_sql(spark):
    from framelode.functions.similarity import register

    register(spark)
    assert list(spark.sql("SELECT path_key('/A/./b\\\\C'), sequence_ratio('abcd', 'bcde'), sequence_ratio(NULL, 'x')").first()) == ["/a/b/c", 0.75, None]


def test_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.json").write_text('{"x": 1,\n "y": "b"}')
    (tmp_path / "b.json").write_text("[1, 2")
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])
    assert R.json_documents(spark, str(tmp_path / "a.json"), schema).first()["x"] == 1
    assert R.json_objects(spark, str(tmp_path / "a.json"), schema).count() == 1
    with pytest.raises(ValueError):
        R.json_objects(spark, str(tmp_path / "b.json"), schema)
    for n in ("m.MP4", "._m.mp4", "n.txt"):
        (tmp_path / n).write_text("x")
    assert [r["name"] for r in R.media_files(spark, str(tmp_path)).collect()] == ["m.MP4"]
    df = spark.createDataFrame([("k", 1, 0.0, 1.5, "hi"), ("k", 2, 2.0, 3.0, "ho")], "k string, n int, s double, e double, t string")
    b = K.subtitle_blocks(df, "k", "n", "s", "e", "t")
    assert b.orderBy("number").first()["block"] == "1\n00:00:00,000 --> 00:00:01,500\nhi"
    K.write_document(df, str(tmp_path / "doc"))
    K.append_log(df, str(tmp_path / "log"))
    K.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_stream_equals_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts")
    far = spark.createDataFrame([(-1, dt.datetime(2100, 1, 1))], "user_id long, ts timestamp_ntz")
    e.unionByName(far).write.mode("overwrite").parquet(str(tmp_path / "in"))
    s = J.sessions(J.event_stream(spark, str(tmp_path / "in"), e.schema), ["user_id"], "ts", "6 hours")
    J.run_available(s, str(tmp_path / "out"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in J.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours").collect()}
    assert got == want and want


def test_unchanged_inputs(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    none = spark.createDataFrame([], "k string, signature string")
    first = J.unchanged(a, none, "k", ["k", "v"])
    assert J.unchanged(a, first, "k", ["k", "v"]).count() == 0 and first.count() == 2


def test_session_names_the_checkpoint_folder(spark):
    from framelode.session import cut_lineage, ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_search_and_lists_check_their_limits(spark, sf):
    from framelode.operators import catalog as Q

    scenes, assets = spark.read.parquet(f"{sf}/scenes.parquet"), spark.read.parquet(f"{sf}/assets.parquet")
    with pytest.raises(ValueError):
        Q.search_scenes(scenes, limit=31)
    with pytest.raises(ValueError):
        Q.list_assets(assets, limit=0)
    first = Q.search_scenes(scenes, "bridge", limit=3).collect()
    assert len(first) == 3 and first[0]["score"] >= first[-1]["score"]
    one = first[0]["asset_id"]
    assert {r["asset_id"] for r in Q.search_scenes(scenes, asset_ids=[one]).collect()} == {one}
    assert Q.search_scenes(scenes, "xyzzy plugh").count() == 0


def test_ui_context(spark, sf):
    from framelode.operators import catalog as Q

    a, s = spark.read.parquet(f"{sf}/assets.parquet"), spark.read.parquet(f"{sf}/scenes.parquet")
    one, two = [r for r in s.filter("source_out > source_in").select("scene_id", "asset_id", "source_in", "source_out").distinct().orderBy("scene_id").limit(40).collect()][:: 39]
    x = Q.resolve_ui_context(a, s, {"focused_scene_id": one["scene_id"], "selected_scene_ids": [two["scene_id"], one["scene_id"], one["scene_id"]], "selected_range": {"source_in": one["source_in"] + 0.01, "source_out": one["source_out"] - 0.01}})
    assert x["current_asset_id"] == one["asset_id"] and x["selected_range"] and {r["scene_id"] for r in x["selected"].collect()} == {one["scene_id"], two["scene_id"]} and x["nearby"].count() == 8
    assert Q.resolve_ui_context(a, s, {"selected_range": {"source_in": "x"}})["selected_range"] is None
    bad = [({"schema_version": "v0"}, ValueError), ({"selected_scene_ids": ["x"] * 13}, ValueError), ({"selected_scene_ids": ["nothing"]}, KeyError), ({"visible_asset_ids": ["nothing"]}, KeyError), ({"focused_scene_id": one["scene_id"], "current_asset_id": two["asset_id"]}, ValueError)]
    bad.append(({"focused_scene_id": one["scene_id"], "selected_range": {"source_in": 0, "source_out": one["source_out"] + 5}}, ValueError))
    for state, error in bad:
        with pytest.raises(error):
            Q.resolve_ui_context(a, s, state)


def test_running_sums_and_numbers_against_windows(spark):
    from pyspark.sql import Window

    from framelode.operators.sequence import with_row_number, with_running_sum

    rnd = random.Random(7)
    df = spark.createDataFrame([(rnd.choice("aab"), rnd.randrange(500), i, rnd.randrange(9)) for i in range(300)], "k string, t long, i long, v long").withColumn("_b", F.floor(F.col("t") / 40).cast("long"))
    w = Window.partitionBy("k").orderBy("t", "i")
    x = with_row_number(with_running_sum(df, ["k"], "_b", ["t", "i"], "v", "s"), ["k"], "_b", ["t", "i"], "n")
    assert {(r["i"], r["s"], r["n"]) for r in x.collect()} == {tuple(r) for r in df.select("i", F.sum("v").over(w), F.row_number().over(w)).collect()}


def test_proposals_against_their_evidence(spark):
    p = [(1, "P1", 1.0, 0.7, "cut", 1), (2, "P2", 5.0, 0.7, "cut", 2), (3, "P3", 4.0, 0.7, "sign", 3), (4, "P4", 20.0, 1.2, "cut", 4), (5, "P5", 21.0, 0.7, "cut", 5), (6, "P6", 22.0, 0.7, "cut", 6), (7, "P6", 23.0, 0.7, "cut", 7), (8, "P8", 31.0, 0.7, "cut", 8)]
    e = [(1, 1.5, "cut", "a", 0.5), (2, 5.0, "cut", "b", 0.5), (2, 8.0, "sign", "c", 0.5), (3, 4.0, "cut", "d", 0.5), (4, 20.0, "cut", "f", 0.5), (6, 22.0, "cut", "g", 0.5), (6, 22.5, "cut", "g", 0.5), (7, 23.0, "cut", "h", 0.5), (8, 31.0, "cut", "i", 1.5)]
    df = spark.createDataFrame([("a", *r) for r in p], "k string, n int, id string, timestamp double, confidence double, primary_kind string, cluster long")
    ev = spark.createDataFrame([("a", *r) for r in e], "k string, cluster long, timestamp double, kind string, source_id string, confidence double")
    whole = spark.createDataFrame([("a", 30.0)], "k string, d double")
    got = {(r["entity_id"], r["message"]) for r in C.proposals(df, ev, whole, "k", "id", "n", "cluster", "d", "x", tolerance=2.0).collect()}
    assert got == {
        ("P2", "evidence beyond the tolerance"), ("P3", "time doesn't increase"), ("P3", "primary kind absent from the evidence"), ("P4", "confidence outside 0 to 1"), ("P5", "no evidence"), ("P6", "id isn't unique"), ("P6", "evidence named twice"),
        ("P8", "outside the media"), ("P8", "evidence outside the media"), ("P8", "confidence of evidence outside 0 to 1"),
    }
