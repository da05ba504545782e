"""Mixed timestamp spellings to one unambiguous form.

A value is read into local calendar fields plus a zone, all by JVM expressions.
Written offsets and abbreviations shift the moment directly.  Place names go
through an as-of join of the local time to zone-offset intervals exploded by
(zone, year): two intervals holding the local time mean it occurred twice, none
means it was skipped, one gives the offset.

The interval table comes from the zone names that occur, which the public tz
database bounds (about 600 names, 137 years, a few rows a year); that bound is
what allows the broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1900, 2035

# Names of the months in English, Marathi and Hindi.
MONTHS = {
    1: "january jan जानेवारी जनवरी",
    2: "february feb फेब्रुवारी फरवरी फ़रवरी",
    3: "march mar मार्च",
    4: "april apr एप्रिल अप्रैल",
    5: "may मे मई",
    6: "june jun जून",
    7: "july jul जुलै जुलाई",
    8: "august aug ऑगस्ट अगस्त",
    9: "september sep sept सप्टेंबर सितंबर सितम्बर",
    10: "october oct ऑक्टोबर अक्टूबर अक्तूबर",
    11: "november nov नोव्हेंबर नवंबर नवम्बर",
    12: "december dec डिसेंबर दिसंबर दिसम्बर",
}

# Zone abbreviations and their offsets in minutes, taken as they stand.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "pkt": 300, "ist": 330, "npt": 345, "sgt": 480, "hkt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360,
    "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

_CLOCK = r"(?:[t ,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?(?![a-z/]))?)?"
_ZONE = r"(?: ?(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5})(?![a-z/_]))?(?: ?\[?([a-z_]+(?:/[a-z0-9_+-]+)+)\]?)?"
_WEEKDAY = r"^(?:\p{L}[\p{L}\p{M}]*,? +(?=\d))?"
_WORD = r"(\p{L}[\p{L}\p{M}]*)"
_END = _CLOCK + _ZONE + "$"

# Each spelling: pattern, and the groups that hold year, month, day, month word.
_SPELLINGS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _END, 1, 2, 3),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _END, 3, 2, 1),
    (r"^(\d{4})(\d{2})(\d{2})" + _END, 1, 2, 3),
    (_WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th)?[ .-]*" + _WORD + r"[ .,-]*(\d{4}|\d{2})" + _END, 3, 2, 1),
    (r"^" + _WORD + r"\.? *(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})" + _END, 3, 1, 2),
]


def _digits(value: Column) -> Column:
    """Decimal digits of the scripts in use as ASCII digits."""
    indic = "".join(chr(0x966 + d) for d in range(10))
    wide = "".join(chr(0xFF10 + d) for d in range(10))
    return F.translate(F.translate(value, indic, "0123456789"), wide, "0123456789")


def clean(value: Column) -> Column:
    """Outer and repeated white space, digit scripts, invisible characters and case do not matter for the reading."""
    plain = F.regexp_replace(_digits(value), r"[­​-‏⁠﻿]", "")
    plain = F.translate(plain, "‐‑‒–−－／：．，", "-----" + "-/:.,")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def _month_number(word: Column) -> Column:
    pairs = [F.lit(x) for m, names in MONTHS.items() for n in names.split() for x in (n, m)]
    return F.try_element_at(F.create_map(*pairs), word)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def read_fields(df: DataFrame, column: str) -> DataFrame:
    """``df`` plus ``__f``: the local fields that ``column`` writes, null where no spelling fits.

    Fields: day (date), secs and micros of the local clock (null: no time of
    day), offset (seconds, null: none written), place (zone name), epoch_us
    (bare counts).  Every spelling is rewritten to one list of parts first, so
    each pattern stands once in the plan.
    """
    v = F.col("__v")
    order = lambda y, m, d: "|".join(f"${k}" for k in (y, m, d, 4, 5, 6, 7, 8, 9, 10))
    parts = F.coalesce(*[F.when(v.rlike(p), F.regexp_replace(v, p, order(y, m, d))) for p, y, m, d in _SPELLINGS])
    # Counts as digits of microseconds: seconds, milli-, micro- and nanoseconds by their length, the fraction as far as it reaches.
    count = r"^(-?)(\d{9,19})(?:[.,](\d+))?$"
    whole, frac = F.regexp_extract(v, count, 2), F.regexp_extract(v, count, 3)
    n = F.length(whole)
    micros = F.when(n <= 10, F.concat(whole, F.rpad(frac, 6, "0"))).when(n <= 13, F.concat(whole, F.rpad(frac, 3, "0"))).when(n <= 16, whole).otherwise(F.regexp_replace(whole, r"\d{3}$", ""))
    df = df.withColumn("__v", clean(F.col(column)))
    df = df.withColumn("__p", F.split(parts, r"\|")).withColumn("__n", F.when(v.rlike(count), F.concat(F.regexp_extract(v, count, 1), micros).try_cast("long")))

    g = dict(zip(("y", "m", "d", "h", "mi", "s", "frac", "half", "zone", "place"), (F.get("__p", F.lit(k)) for k in range(10))))
    year = F.when(F.length(g["y"]) == 2, F.when(_int(g["y"]) < 70, _int(g["y"]) + 2000).otherwise(_int(g["y"]) + 1900)).otherwise(_int(g["y"]))
    month = F.coalesce(_int(g["m"]), _month_number(g["m"]))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(g["d"])), "yyyy-MM-dd")
    hour = F.when(g["half"] == "", _int(g["h"])).when(_int(g["h"]).between(1, 12), _int(g["h"]) % 12 + F.when(g["half"] == "p", 12).otherwise(0))
    sec = F.coalesce(_int(g["s"]), F.lit(0))
    secs = F.when((hour < 24) & (_int(g["mi"]) < 60) & (sec < 60), hour * 3600 + _int(g["mi"]) * 60 + sec)
    offsets = F.create_map(*[F.lit(x) for k, m in ABBREVIATIONS.items() for x in (k, m * 60)])
    numeric = _int(F.substring(g["zone"], 2, 2)) * 3600 + F.coalesce(_int(F.regexp_extract(g["zone"], r"^.\d\d:?(\d\d)$", 1)), F.lit(0)) * 60
    offset = F.when(g["zone"].startswith("+"), numeric).when(g["zone"].startswith("-"), -numeric).otherwise(F.try_element_at(offsets, g["zone"]))
    df = df.withColumn("__d", F.struct(day.alias("day"), secs.alias("secs"), offset.alias("offset")))

    timed = g["h"] != ""
    zoned = g["zone"] != ""
    d = lambda k: F.col(f"__d.{k}")
    sound = d("day").isNotNull() & F.when(timed, d("secs").isNotNull() & (~zoned | d("offset").isNotNull())).otherwise(~zoned & (g["place"] == ""))
    null = lambda t: F.lit(None).cast(t)
    bare = F.struct(null("date").alias("day"), null("int").alias("secs"), null("int").alias("micros"), null("int").alias("offset"), null("string").alias("place"), F.col("__n").alias("epoch_us"))
    written = F.struct(
        d("day").alias("day"),
        F.when(timed, d("secs")).alias("secs"),
        F.when(timed, F.coalesce(_int(F.rpad(F.substring(g["frac"], 1, 6), 6, "0")), F.lit(0))).alias("micros"),
        F.when(timed & zoned, d("offset")).alias("offset"),
        F.when(timed & ~zoned & (g["place"] != ""), g["place"]).alias("place"),
        null("long").alias("epoch_us"),
    )
    return df.withColumn("__f", F.when(F.col("__n").isNotNull(), bare).when(sound, written))


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(place, year, spans): offset intervals in local seconds, by zone and year.

    ``zones`` has a column ``place``.  Unknown names give no rows.  ``spans`` is
    ordered by time and holds each interval that touches the year or the two
    days around it, so a skipped time still sees the interval before it.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zoneinfo import ZoneInfo, available_timezones

        names = {n.lower(): n for n in available_timezones()}
        day, origin = 86400, datetime(1970, 1, 1, tzinfo=timezone.utc)
        lo, hi = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - origin).total_seconds()), int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc) - origin).total_seconds())
        for batch in batches:
            for place in batch["place"]:
                if place not in names:
                    continue
                zone = ZoneInfo(names[place])
                at = lambda t: int((origin + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
                spans, begin, now = [], lo - 40 * day, at(lo - 40 * day)
                for t in range(begin, hi + 40 * day, 10 * day):
                    if at(t + 10 * day) != now:
                        a, b = t, t + 10 * day
                        while b - a > 1:
                            mid = (a + b) // 2
                            a, b = (a, mid) if at(mid) != now else (mid, b)
                        spans.append((begin, b, now))
                        begin, now = b, at(b)
                spans.append((begin, hi + 60 * day, now))
                rows = []
                for y in range(FIRST_YEAR, LAST_YEAR + 1):
                    first = int((datetime(y, 1, 1, tzinfo=timezone.utc) - origin).total_seconds()) - 2 * day
                    last = first + 370 * day
                    rows.append((place, y, [{"start": s + o, "stop": e + o, "offset": o} for s, e, o in spans if s + o < last and e + o > first]))
                yield pd.DataFrame(rows, columns=["place", "year", "spans"])

    return zones.select("place").distinct().mapInPandas(build, "place string, year int, spans array<struct<start:long,stop:long,offset:int>>")


def normalise(df: DataFrame, column: str, default_offset: int = 19800) -> DataFrame:
    """``df`` plus ``normal_form`` and ``time_status``.

    ``normal_form`` is YYYY-MM-DD for a day, YYYY-MM-DDTHH:MM:SS.ffffffZ for a
    moment, null for what is no real date of the years 1900-2035 (null and empty
    values too).  ``time_status`` is day, exact, ambiguous (first of two),
    skipped (offset before the change) or null.  Times without a zone have
    ``default_offset`` (Indian time).  Columns of those two names are replaced.
    """
    base = read_fields(df.drop("normal_form", "time_status"), column)
    # A superset of the place names: what ends like one. Unknown names give no intervals.
    zones = df.select(F.regexp_extract(F.lower(F.col(column)), r"([a-z_]+(?:/[a-z0-9_+-]+)+)\]?\s*$", 1).alias("place")).where("place <> ''")
    spans = F.broadcast(zone_intervals(zones).withColumnRenamed("place", "__place").withColumnRenamed("year", "__year").withColumnRenamed("spans", "__spans"))
    joined = base.join(spans, (F.col("__f.place") == F.col("__place")) & (F.year("__f.day") == F.col("__year")), "left")
    local = F.unix_date("__f.day").cast("long") * 86400 + F.col("__f.secs")
    joined = joined.withColumn("__local", local)
    hits = F.filter("__spans", lambda s: (s["start"] <= F.col("__local")) & (F.col("__local") < s["stop"]))
    before = F.element_at(F.filter("__spans", lambda s: s["stop"] <= F.col("__local")), -1)
    joined = joined.withColumn("__hits", hits)
    n = F.size("__hits")
    place_offset = F.when(n >= 1, F.array_max(F.transform("__hits", lambda s: s["offset"]))).otherwise(F.when(F.col("__spans").isNotNull(), before["offset"]))
    has_place = F.col("__f.place").isNotNull()
    offset = F.when(has_place, place_offset).otherwise(F.coalesce("__f.offset", F.lit(default_offset)))
    us = F.coalesce(F.col("__f.epoch_us"), (F.col("__local") - offset) * 1_000_000 + F.col("__f.micros"))
    sec, frac = F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("long"), F.pmod(us, F.lit(1_000_000))
    day, clock = F.floor(sec / 86400).cast("int"), F.pmod(sec, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    moment = F.concat(
        F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), F.lit("T"), two(clock / 3600), F.lit(":"), two(clock % 3600 / 60), F.lit(":"),
        two(clock % 60), F.lit("."), F.lpad(frac.cast("string"), 6, "0"), F.lit("Z"),
    )
    written = F.coalesce(F.year("__f.day"), F.year(F.date_from_unix_date(day)))
    form = F.when(F.col("__f.secs").isNull() & F.col("__f.epoch_us").isNull(), F.date_format("__f.day", "yyyy-MM-dd")).otherwise(moment)
    status = (
        F.when(F.col("__f.secs").isNull() & F.col("__f.epoch_us").isNull(), "day")
        .when(has_place & (n == 0), "skipped").when(has_place & (n > 1), "ambiguous").otherwise("exact")
    )
    real = written.between(FIRST_YEAR, LAST_YEAR) & form.isNotNull()
    return (
        joined.withColumn("normal_form", F.when(real, form)).withColumn("time_status", F.when(real, status))
        .select(*df.drop("normal_form", "time_status").columns, "normal_form", "time_status")
    )
