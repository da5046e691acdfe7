"""Edits as append-only revisions of a list of clips."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLIP = "struct<id:string,scene_id:string,source:string,source_in:double,source_out:double,label:string,speed:double>"


class StaleHead(ValueError):
    """Somebody else committed a revision first."""


def heads(revisions: DataFrame) -> DataFrame:
    """The latest revision of each edit (SRC9, A16)."""
    return revisions.groupBy("edit_id").agg(F.max_by(F.struct(*[c for c in revisions.columns if c != "edit_id"]), "sequence").alias("_r")).select("edit_id", "_r.*")


def history(revisions: DataFrame, edit_id: str, limit: int = 30) -> DataFrame:
    """The newest revisions of one edit (SRC9)."""
    return revisions.filter(F.col("edit_id") == edit_id).orderBy(F.desc("sequence")).limit(limit)


def duration(clips: Column) -> Column:
    """Length of a list of clips at their speeds."""
    return F.aggregate(clips, F.lit(0.0), lambda a, c: a + (c["source_out"] - c["source_in"]) / F.coalesce(c["speed"], F.lit(1.0)))


def add_clip(clips: Column, clip: Column) -> Column:
    return F.array_append(clips, clip)


def remove_clip(clips: Column, clip_id) -> Column:
    return F.filter(clips, lambda c: c["id"] != clip_id)


def trim_clip(clips: Column, clip_id, source_in: float, source_out: float) -> Column:
    """New bounds of one clip; all others stay."""
    if source_out <= source_in:
        raise ValueError("a range must have a length")
    return F.transform(clips, lambda c: F.when(c["id"] == clip_id, c.withField("source_in", F.lit(float(source_in))).withField("source_out", F.lit(float(source_out)))).otherwise(c))


def move_clip(clips: Column, clip_id, to_index: int) -> Column:
    """The clip taken out and put back at a place counted from zero."""
    one = F.get(F.filter(clips, lambda c: c["id"] == clip_id), F.lit(0))
    return F.when(F.exists(clips, lambda c: c["id"] == clip_id), F.array_insert(remove_clip(clips, clip_id), to_index + 1, one)).otherwise(clips)


def within(source_in: Column, source_out: Column, low: Column, high: Column) -> Column:
    """Whether a range has a length and stays inside a scene (a millisecond of slack)."""
    return (source_out > source_in) & (source_in >= low - 0.001) & (source_out <= high + 0.001)


def commit(spark: SparkSession, path: str, edit_id: str, expected_head: str | None, revision: DataFrame) -> None:
    """Append one revision (parquet at ``path``) if the edit's head is still the expected one (SNK3).

    A file named after edit and sequence, which the file system creates for one writer only, makes
    this safe between drivers. It is removed again if the revision can't be written.
    """
    now = _head(spark, path, edit_id)
    if (now["revision_id"] if now else None) != expected_head:
        raise StaleHead(f"the head of {edit_id} is {now['revision_id'] if now else 'unset'}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{slug_of(edit_id)}-{now['sequence'] + 1 if now else 1}")
    fs = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.createNewFile(mark):
        raise StaleHead(f"another writer is adding to {edit_id}")
    try:
        revision.write.mode("append").parquet(path)
    except BaseException:
        fs.delete(mark, False)
        raise


def slug_of(edit_id: str) -> str:
    """A file name for an id."""
    return hashlib.sha256(edit_id.encode()).hexdigest()[:32]


def _head(spark: SparkSession, path: str, edit_id: str) -> Row | None:
    try:
        return heads(spark.read.parquet(path).filter(F.col("edit_id") == edit_id)).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


REVISION = f"edit_id string, revision_id string, parent_revision_id string, sequence int, title string, brief string, target_duration double, clips array<{CLIP}>, summary string, created_by string, created_at timestamp"
# Limits of titles, summaries, operations in a batch and target durations.
TITLE, SUMMARY, BATCH, TARGET = 120, 240, 100, (5.0, 7200.0)


def _title(x) -> str:
    t = str(x or "").strip()
    if not 1 <= len(t) <= TITLE:
        raise ValueError(f"a title has 1 to {TITLE} characters")
    return t


def _target(x) -> float:
    if x is None or not TARGET[0] <= float(x) <= TARGET[1]:
        raise ValueError("a target duration is from {} to {} seconds".format(*TARGET))
    return float(x)


def create_edit(spark: SparkSession, path: str, edit_id: str, title: str, *, brief: str = "", target_duration: float | None = None, created_by: str = "user") -> Row:
    """A new edit without clips; its first revision."""
    first = {"edit_id": edit_id, "title": _title(title), "brief": brief, "target_duration": None if target_duration is None else _target(target_duration), "clips": []}
    return _append(spark, path, first, None, 1, "created", created_by)


def get_edit(spark: SparkSession, path: str, edit_id: str) -> Row:
    """The head of an edit with its number of clips and their length; an unknown edit is a KeyError."""
    head = _head(spark, path, edit_id)
    if head is None:
        raise KeyError(f"no edit {edit_id}")
    n = sum((c["source_out"] - c["source_in"]) / (c["speed"] or 1.0) for c in head["clips"])
    return Row(**head.asDict(), clip_count=len(head["clips"]), timeline_duration=round(n, 3))


def _append(spark: SparkSession, path: str, state: dict, parent: str | None, sequence: int, summary: str, by: str) -> Row:
    row = state | {"revision_id": "rev_" + uuid.uuid4().hex[:16], "parent_revision_id": parent, "sequence": sequence, "summary": summary, "created_by": by, "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)}
    fields = [f.name for f in T.StructType.fromDDL(REVISION)]
    commit(spark, path, state["edit_id"], parent, spark.createDataFrame([tuple(row.get(f) for f in fields)], REVISION))
    return get_edit(spark, path, state["edit_id"])


def apply_operations(spark: SparkSession, path: str, scenes: DataFrame, edit_id: str, expected_head: str, summary: str, operations: list[dict], *, created_by: str = "user") -> Row:
    """One revision more of an edit, by up to ``BATCH`` operations that all hold or none does.

    Operations: add_scene (scene_id, source_in, source_out, label), trim_clip (clip_id, source_in, source_out), move_clip
    (clip_id, to_index), remove_clip (clip_id), set_title (title), set_target_duration (target_duration). Ranges stay in their
    scene. ``scenes``: scene_id, asset_id, source_in, source_out, title; only those named are read.
    """
    if not 1 <= len(summary.strip()) <= SUMMARY:
        raise ValueError(f"a summary has 1 to {SUMMARY} characters")
    if not 1 <= len(operations) <= BATCH:
        raise ValueError(f"a batch has 1 to {BATCH} operations")
    head = get_edit(spark, path, edit_id)
    if head["revision_id"] != expected_head:
        raise StaleHead(f"the head of {edit_id} is {head['revision_id']}")
    state = {k: head[k] for k in ("edit_id", "title", "brief", "target_duration")} | {"clips": [c.asDict() for c in head["clips"]]}
    clips = state["clips"]
    wanted = {o.get("scene_id") for o in operations if o.get("op") == "add_scene"} | {c["scene_id"] for c in clips}
    known = {r["scene_id"]: r for r in scenes.filter(F.col("scene_id").isin([x for x in wanted if x])).select("scene_id", "asset_id", "source_in", "source_out", "title").distinct().collect()} if wanted else {}

    def span(o: dict, now: tuple[float, float], scene_id: str) -> dict:
        a, b = float(o.get("source_in", now[0])), float(o.get("source_out", now[1]))
        s = known[scene_id]
        if not a < b or a < s["source_in"] - 0.001 or b > s["source_out"] + 0.001:
            raise ValueError("a range has a length and stays in its scene")
        return {"source_in": round(a, 6), "source_out": round(b, 6)}

    def place(o: dict) -> int:
        at = next((i for i, c in enumerate(clips) if c["id"] == o.get("clip_id")), None)
        if at is None:
            raise KeyError(f"no clip {o.get('clip_id')}")
        return at

    for o in operations:
        match o.get("op"):
            case "add_scene":
                s = known.get(o.get("scene_id"))
                if s is None:
                    raise KeyError(f"no scene {o.get('scene_id')}")
                clips.append({"id": "clip_" + uuid.uuid4().hex[:16], "scene_id": s["scene_id"], "source": s["asset_id"], "label": str(o.get("label") or s["title"] or "")[:160], "speed": 1.0} | span(o, (s["source_in"], s["source_out"]), s["scene_id"]))
            case "trim_clip":
                c = clips[place(o)]
                c |= span(o, (c["source_in"], c["source_out"]), c["scene_id"])
            case "move_clip":
                at, to = place(o), int(o.get("to_index", -1))
                if not 0 <= to < len(clips):
                    raise ValueError("to_index lies in the list of clips")
                clips.insert(to, clips.pop(at))
            case "remove_clip":
                clips.pop(place(o))
            case "set_title":
                state["title"] = _title(o.get("title"))
            case "set_target_duration":
                state["target_duration"] = _target(o.get("target_duration"))
            case other:
                raise ValueError(f"no operation {other}")
    return _append(spark, path, state, expected_head, head["sequence"] + 1, summary.strip(), created_by)
