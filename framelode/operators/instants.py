"""One UTC instant from capture times in many writings (problem 7).

A cascade of anchored patterns, each strict; the first that matches decides. Written zones
win; without one the record's own zone is used, and clock times that occur twice or never
there have no instant. All expressions are built in, nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations with one meaning, in minutes east of UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "KST": 540, "JST": 540, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# English month names as written in dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Days that clocks show which were never set.
UNSET_DAYS = ["1900-01-01", "1904-01-01", "1970-01-01", "1980-01-01", "1980-01-06", "2000-01-01", "2001-01-01"]
# Epochs of bare numbers, in seconds before 1970.
EPOCHS = {"1970": 0, "1904": 2082844800, "1900": 2208988800, "2001": -978307200}
#: Bare numbers must fall from the first to before the second of these (2024-01-01 to 2027-01-01 UTC, in milliseconds).
NUMBER_RANGE_MS = (1704067200000, 1798761600000)

_TIME = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TIME12 = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?"
#: The cascade: pattern, and the places of year, month, day, hour, minute, second, fraction, zone, half of day in it (0: none).
PATTERNS = [
    (rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_TIME} ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    (rf"(?i)^(\d{{4}}):(\d{{2}}):(\d{{2}}) {_TIME} ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    (rf"(?i)^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_TIME} ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})[T_-]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))? ?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    (rf"(?i)^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(\d{{1,2}}) ([A-Z]{{3}})[a-z]* (\d{{4}}) {_TIME} ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 0)),
    (rf"(?i)^([A-Z]{{3}})[a-z]* (\d{{1,2}}), (\d{{4}}),? {_TIME12} ?(AM|PM)? ?{_ZONE}$", (3, 1, 2, 4, 5, 6, 7, 9, 8)),
    (rf"(?i)^(\d{{4}})년 ?(\d{{1,2}})월 ?(\d{{1,2}})일 (오전|오후)? ?{_TIME12} ?{_ZONE}$", (1, 2, 3, 5, 6, 7, 8, 9, 4)),
    (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_TIME} ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 0)),
]
#: Two numbers before the year: read day first and month first, and used only if one reading is possible or both agree.
EITHER_ORDER = rf"(?i)^(\d{{2}})/(\d{{2}})/(\d{{4}}),? {_TIME} ?{_ZONE}$"


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("int")


def _fields(t: Column) -> Column:
    """The nine fields of a text as one string with bars between, by the first pattern that matches."""
    found = [F.when(t.rlike(p), F.regexp_replace(t, p, "|".join(f"${i}" if i else "" for i in at))) for p, at in PATTERNS]
    return F.coalesce(*found, F.when(t.rlike(EITHER_ORDER), F.regexp_replace(t, EITHER_ORDER, "$3|$2|$1|$4|$5|$6|$7|$8|")))


def _month(c: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c)).cast("int")
    return F.when(c.rlike("^[0-9]"), _int(c)).otherwise(F.when(named > 0, named))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it.

    Without it every reference would be a copy of the whole expression, also where Catalyst
    pushes a filter down, and the expression would grow as a power of the steps.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _wall(fields: Column, either: Column) -> Column:
    """Struct(wall in ms, written zone) of split fields; wall is null where a field is impossible."""
    f = lambda i: F.get(fields, F.lit(i))
    hour, low = _int(f(3)), F.lower(f(8))
    hour = F.when(low.isin("pm", "오후", "am", "오전"), F.when((hour >= 1) & (hour <= 12), hour % 12 + F.when(low.isin("pm", "오후"), 12).otherwise(0))).otherwise(F.when(hour <= 23, hour))
    minute, second = F.when(_int(f(4)) <= 59, _int(f(4))), F.coalesce(_int(f(5)), F.lit(0))
    ms = F.coalesce(_int(F.substring(F.rpad(f(6), 3, "0"), 1, 3)), F.lit(0))
    in_day = F.when(second <= 59, hour * 3_600_000 + minute * 60_000 + second * 1000 + ms).cast("long")
    dates = F.struct(_date(f(0), _month(f(1)), f(2)).alias("a"), F.when(either, _date(f(0), _int(f(2)), _month(f(1)))).alias("b"))
    date = _let(dates, lambda d: F.when(d["b"].isNull(), d["a"]).when(d["a"].isNull() | (d["a"] == d["b"]), d["b"]))
    wall = _let(date, lambda d: F.when(~d.cast("string").isin(UNSET_DAYS), F.unix_date(d).cast("long") * 86_400_000 + in_day))
    return F.struct(wall.alias("wall"), F.upper(F.when(f(7) != "", f(7))).alias("zone"))


def _east(zone: Column) -> Column:
    """A written zone in minutes east of UTC, null if it isn't known."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone)

    def shift(n: Column) -> Column:
        h = _int(F.when(F.length(n) <= 2, n).otherwise(F.left(n, F.length(n) - 2)))
        m = F.when(F.length(n) <= 2, F.lit(0)).otherwise(_int(F.right(n, F.lit(2))))
        return F.when((h <= 14) & (m <= 59), F.when(zone.contains("-"), -1).otherwise(1) * (h * 60 + m))

    return F.when(zone.rlike("[+-]"), _let(F.regexp_replace(zone, "^(UTC|GMT)?[+-]|:", ""), shift)).otherwise(named)


def _local(wall: Column, tz: Column) -> Column:
    """UTC milliseconds of a clock time in a zone, null where it occurs twice or never.

    The offsets a day before and a day after are the only ones that a clock change nearby can
    offer; one counts if it leads back to the same clock time.
    """
    there = lambda x: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(x), tz))
    day = 86_400_000
    about = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), tz))
    guess = _let(about, lambda x: F.struct((wall - (there(x - day) - (x - day))).alias("a"), (wall - (there(x + day) - (x + day))).alias("b")))
    good = _let(guess, lambda g: F.struct(F.when(there(g["a"]) == wall, g["a"]).alias("a"), F.when(there(g["b"]) == wall, g["b"]).alias("b")))
    return _let(good, lambda g: F.when(g["a"].isNull() | (g["a"] == g["b"]), g["b"]).when(g["b"].isNull(), g["a"]))


def _number(t: Column) -> Column:
    """UTC milliseconds of a bare number: by the only epoch and unit that put it in the allowed years, else null."""
    low, high = NUMBER_RANGE_MS
    number = F.when(t.rlike(r"^\d{1,20}(\.\d{1,9})?$"), t).try_cast("decimal(29,9)")
    units = F.array(*(F.lit(x).cast("decimal(10,0)") for x in (1, 10**3, 10**6, 10**9)))
    since = F.transform(units, lambda per: F.floor(number * 1000 / per).try_cast("long"))
    backs = F.array(*(F.lit(x * 1000).cast("long") for x in EPOCHS.values()))
    fits = F.filter(F.flatten(F.transform(backs, lambda back: F.transform(since, lambda x: x - back))), lambda x: (x >= low) & (x < high))
    return _let(F.array_distinct(fits), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))


def utc_millis(text: Column, zone: Column) -> Column:
    """UTC milliseconds of a written time, null if it doesn't denote exactly one instant.

    Cases: null, blank, placeholders, impossible dates, unknown written zones, days that show
    an unset clock and day/month orders that allow two readings give null. A null ``zone``
    (IANA) leaves values without a written zone null. Digits finer than a millisecond are cut off.
    """

    def of(t: Column) -> Column:
        clock = _let(
            _let(F.split(_fields(t), r"\|", -1), lambda f: _wall(f, t.rlike(EITHER_ORDER))),
            lambda w: F.when(w["zone"].isNull(), _local(w["wall"], zone)).otherwise(w["wall"] - _east(w["zone"]).cast("long") * 60_000),
        )
        return F.when(t.rlike(r"^[0-9.]+$") & ~t.rlike(r"^\d{14}$"), _number(t)).otherwise(clock)

    return _let(F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " ")), of)


def with_utc(df: DataFrame, text: str, zone: str, name: str = "utc_ms") -> DataFrame:
    """Add ``name``: UTC milliseconds of column ``text``, read in column ``zone`` where it writes none; other columns are kept."""
    return df.withColumn(name, utc_millis(F.col(text), F.col(zone)))


def asset_instants(assets: DataFrame, trip_config: DataFrame) -> DataFrame:
    """asset_id, utc_ms (null where none can be told), one row per asset; whole-row copies count once.

    ``trip_config`` has one small row per trip; Spark broadcasts it when its size allows.
    """
    a = assets.filter(F.col("asset_id").isNotNull()).select("asset_id", "trip_id", "creation_time").distinct()
    z = trip_config.select("trip_id", F.col("time_zone").alias("_zone")).dropDuplicates(["trip_id"])
    return with_utc(a.join(z, "trip_id", "left"), "creation_time", "_zone").select("asset_id", "utc_ms")
