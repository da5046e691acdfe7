"""Compare a query with its DuckDB twin: names, row count and values, whatever the order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings assets stt_candidates stt_spans scenes vision_samples ocr_lines person_detections reading_labels trip_config speaker_roster pack_limits mix_targets".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else (round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if they agree, else what differs."""
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got = rows(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; only here {[x for x in got if x not in set(want)][:2]}, only there {[x for x in want if x not in set(got)][:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else None
