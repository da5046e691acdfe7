"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_dec(x, digits: int) -> Column:
    """Round half up in decimal, which two engines agree on; null and NaN give null."""
    c = col(x)
    return F.round(F.when(~F.isnan(c.cast("double")), c).cast("decimal(24,12)"), digits).cast("double")


def unit(x, digits: int = 4) -> Column:
    """Clamp to [0, 1] and round (M1)."""
    return round_dec(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x).cast("double"))), digits)


def _millis(seconds) -> Column:
    return F.greatest(F.lit(0), F.round(col(seconds).cast("decimal(24,12)") * 1000, 0).cast("long"))


def timecode(seconds) -> Column:
    """MM:SS.mmm, with HH: in front from one hour on; negative gives zero, null gives null."""
    ms = _millis(seconds)
    h, m, s, r = F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000
    text = F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, r)).otherwise(F.format_string("%02d:%02d.%03d", m, s, r))
    return F.when(ms.isNotNull() & col(seconds).isNotNull(), text)


def srt_time(seconds) -> Column:
    """HH:MM:SS,mmm of subtitles."""
    ms = _millis(seconds)
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)
    return F.when(col(seconds).isNotNull(), text)


def short_time(seconds) -> Column:
    """M:SS, or H:MM:SS from one hour on, whole seconds cut off (S3)."""
    s = F.floor(F.greatest(F.lit(0.0), col(seconds))).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60
    return F.when(col(seconds).isNotNull(), F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r)))


def one_line(text) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def compact_text(text) -> Column:
    """As one_line, without space before punctuation."""
    return one_line(F.regexp_replace(col(text), r"\s+([,.!?])", "$1"))


def comparable(text) -> Column:
    """Only digits, Latin letters and Hangul, in lower case."""
    return F.lower(F.regexp_replace(col(text), "[^0-9A-Za-z가-힣]+", ""))


def tokens(text, least: int = 2) -> Column:
    """Words of at least ``least`` characters, lower case, first occurrences only."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) >= least))


def shortened(text, limit: int) -> Column:
    """One line of at most ``limit`` characters, cut ones end in an ellipsis."""
    t = one_line(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def slug(text) -> Column:
    """Letters, digits, dots, underscores and hyphens; others become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(text), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def safe_id(text) -> Column:
    """Whether a text can be an identifier."""
    return F.coalesce(col(text).rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def namespaced(ids, prefix) -> Column:
    """Ids with a prefix, once."""
    p = F.concat(col(prefix), F.lit(":"))
    return F.transform(col(ids), lambda x: F.when(F.startswith(x, p), x).otherwise(F.concat(p, x)))


def ends_sentence(text) -> Column:
    """Whether the text ends in sentence punctuation."""
    return F.coalesce(col(text).rlike(r"[.?!。？！]$"), F.lit(False))


def trails_off(text) -> Column:
    """Whether the text holds an ellipsis."""
    return F.coalesce(col(text).contains("…") | col(text).contains("..."), F.lit(False))


def chunks(text, size: int) -> Column:
    """The text in pieces of ``size`` characters; an empty text has none."""
    t = col(text)
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(t.isNull(), F.lit(None)).when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * size + 1, F.lit(size))))


def overlap(a, b, c, d) -> Column:
    """Seconds that [a, b] and [c, d] share (M2)."""
    return F.greatest(F.lit(0.0), F.least(col(b), col(d)) - F.greatest(col(a), col(c)))


def jaccard(a, b) -> Column:
    """Shared part of two arrays as sets; 1 if both are empty (M4)."""
    x, y = F.array_distinct(col(a)), F.array_distinct(col(b))
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / u)


def hamming64(a, b) -> Column:
    """Share of different bits of two hashes of 16 hex digits (M6); in halves, as one cast would overflow."""
    bits = lambda i: F.bit_count(F.conv(F.substring(col(a), i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(col(b), i, 8), 16, 10).cast("long")))
    return (bits(1) + bits(9)) / 64.0


def average_hash(luma) -> Column:
    """16 hex digits of the bits of 64 values at or above their mean (M5); null for another number of values."""
    v = col(luma)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / 64
    digit = lambda g: F.aggregate(F.slice(F.transform(v, lambda x: (x >= mean).cast("int")), g * 4 + 1, 4), F.lit(0), lambda a, b: a * 2 + b)
    return F.when(F.size(v) == 64, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda g: F.lower(F.hex(digit(g)))), ""))


def frame_quality(brightness, contrast, sharpness) -> Column:
    """Quality of a frame from its statistics (M7)."""
    penalty = F.greatest(F.lit(0.0), 0.10 - col(brightness)) * 3 + F.greatest(F.lit(0.0), col(brightness) - 0.92) * 3
    return unit(0.55 + col(sharpness) * 1.8 + col(contrast) * 0.5 - penalty)


def exposure_flags(brightness, sharpness) -> Column:
    """Names of what is wrong with a frame (M7)."""
    b = col(brightness)
    return F.array_compact(F.array(F.when(b < 0.10, "dark").when(b > 0.92, "overexposed"), F.when(col(sharpness) < 0.035, "low_detail")))


def rational(text) -> Column:
    """Number of a text like 30000/1001; a zero denominator or no number gives null."""
    p = F.split(col(text), "/", -1)
    top, low = F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.when(F.size(p) > 1, F.get(p, F.lit(1)).try_cast("double")), F.when(F.size(p) == 1, F.lit(1.0)))
    return F.when(low != 0, top / low)


def tempo_steps(speed) -> Column:
    """Factors within [0.5, 2] whose product is the speed (M12): powers of 2 or a half, then the rest. A speed not above 0 gives null."""
    s = col(speed)
    base = F.when(s > 2, F.lit(2.0)).when(s < 0.5, F.lit(0.5))
    n = F.when(s > 2, F.ceil(F.log2(s)) - 1).when(s < 0.5, F.ceil(-F.log2(s)) - 1).otherwise(0).cast("int")
    rest = round_dec(s / F.pow(F.coalesce(base, F.lit(1.0)), n), 9)
    return F.when(s > 0, F.concat(F.array_repeat(F.coalesce(base, F.lit(1.0)), n), F.array(rest)))


def digest(*cols) -> Column:
    """SHA-256 of the values as JSON with keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def stable_id(*cols) -> Column:
    """First 16 digits of the digest of values joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in cols)), 256), 1, 16)


def capture_day(text) -> Column:
    """First ten characters of a time, 'unknown' if it has fewer (D)."""
    return F.when(F.length(col(text)) >= 10, F.substring(col(text), 1, 10)).otherwise("unknown")


def valid_day(text) -> Column:
    """Whether a text is a date YYYY-MM-DD (D)."""
    return col(text).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & col(text).try_cast("date").isNotNull()


def sequential_id(prefix: str, digits: int, number) -> Column:
    """Ids such as BP0001."""
    return F.format_string(f"{prefix}%0{digits}d", col(number).cast("long"))


def accepted_status(status, accepted: list[str]) -> Column:
    """Whether a status, however written, is among the accepted ones; null isn't (P5)."""
    return F.coalesce(F.lower(F.trim(col(status))).isin(accepted), F.lit(False))


def band(value, high: float, medium: float) -> Column:
    """high, medium or low; unknown for null."""
    c = col(value)
    return F.when(c.isNull(), "unknown").when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def recommendation(importance, scene_type, poor, key_moment) -> Column:
    """keep, trim, bridge or review (P12); an unknown importance is a half."""
    i, no = F.coalesce(col(importance), F.lit(0.5)), F.lit(False)
    kind = F.coalesce(col(scene_type), F.lit(""))
    trim = (i <= 0.25) | (kind == "camera_handling") | F.coalesce(poor, no)
    return F.when(F.coalesce(key_moment, no), "keep").when(trim, "trim").when(i >= 0.72, "keep").when((kind == "transition") | (i < 0.5), "bridge").otherwise("review")


def display_signals(claims, dialogue, people, attention) -> Column:
    """Signals of a candidate in a fixed order, subjects by first occurrence (P18): claims have kind and basis."""
    suffix = lambda b: F.when(b == "speech", " (said)").when(b == "inferred", " (inferred)").otherwise("")
    subjects = F.array_distinct(F.transform(claims, lambda c: F.concat(c["kind"], suffix(c["basis"]))))
    return F.concat(subjects, F.array_compact(F.array(F.when(dialogue, "dialogue"), F.when(people, "people"), F.when(attention, "attention"))))


def duration_text(seconds) -> Column:
    """A length in words, rounded to seconds: 45s, 2m 5s, 1h 10m (S3)."""
    r = F.round(col(seconds).cast("decimal(24,6)")).cast("long")
    h, m = F.floor(r / 3600).cast("string"), F.floor(r % 3600 / 60).cast("string")
    return F.when(r >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(r >= 60, F.concat(m, F.lit("m "), (r % 60).cast("string"), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


def with_namespace(df: DataFrame, prefix: str, ids: list[str], references: list[str]) -> DataFrame:
    """Ids, and in arrays all references to them, with the prefix in front, once."""
    return df.withColumns({c: F.get(namespaced(F.array(c), prefix), F.lit(0)) for c in ids} | {c: namespaced(c, prefix) for c in references})


def merged_maps(base, over) -> Column:
    """The keys of both maps; of common ones the later's value unless it is null."""
    given = F.map_filter(over, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), given)


def tree_digest(files: DataFrame, keys: list[str], path: str, digest: str) -> DataFrame:
    """keys, digest: SHA-256 of the lines "path digest" of a folder's files in the order of paths (M10). A folder is one array."""
    lines = F.sort_array(F.collect_list(F.struct(path, digest)))
    return files.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws(" ", x[path], x[digest])), "\n"), 256).alias("digest"))


def capture_label(text) -> tuple[Column, Column]:
    """Clock time (with UTC if it is said) and day of a time as written; what isn't one is shown as it is (D3)."""
    c = col(text)
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
    at = F.regexp_replace(F.regexp_extract(c, shape, 1), "T", " ").try_cast("timestamp_ntz")
    empty = F.coalesce(c, F.lit("")) == ""
    utc = F.when(c.rlike("(Z|[+-]00:?00)$"), " UTC").otherwise("")
    label = F.when(empty, "unknown time").when(at.isNull(), c).otherwise(F.concat(F.date_format(at, "HH:mm"), utc))
    return label, F.when(empty, "no capture time").when(at.isNull(), "as written").otherwise(F.date_format(at, "yyyy.MM.dd"))


def now_utc() -> Column:
    """The current time as YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
