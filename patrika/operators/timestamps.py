"""Dates and times in mixed notations and zones, brought to one unambiguous form.

A value is read with column expressions alone. A local time is placed by an as-of join with the
zone's offset intervals: each interval covers [local_from, local_to) of wall-clock seconds, so a local
time inside two intervals is ambiguous, inside none it does not exist, inside one the offset is known.
The intervals are exploded by (zone, year), which turns the as-of condition into an equi-join; the
table is bounded by the zones of the tz database times the years covered and is therefore broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1970, 2100

# Zone abbreviations and their offsets in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "bst": 60, "cet": 60, "cest": 120, "gst": 240, "ist": 330, "npt": 345,
    "aest": 600, "aedt": 660, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420,
}

# Month names in English (by their first three letters) and Hindi.
MONTHS_EN = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTHS_HI = {
    "जनवरी": 1, "फरवरी": 2, "फ़रवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8,
    "सितंबर": 9, "सितम्बर": 9, "अक्टूबर": 10, "अक्तूबर": 10, "नवंबर": 11, "नवम्बर": 11, "दिसंबर": 12, "दिसम्बर": 12,
}

_WORD = r"(\p{L}[\p{L}\p{M}]+)"
_ISO = r"^(?:.*?[^\d])?(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)(.*)$"
_NUMERIC = r"^(?:.*?[^\d])?(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?!\d)(.*)$"
_DAY_WORD = rf"^(?:.*?[^\d])?(\d{{1,2}})(?:st|nd|rd|th)?[ \-]{_WORD}\.?,?[ \-](\d{{4}}|\d{{2}})(?!\d)(.*)$"
_WORD_DAY = rf"^(?:.*?[^\p{{L}}\p{{M}}])?{_WORD}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)(.*)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?(z|[+-]\d{4})?)?$"
_TIME = r"^[^\d]*?(\d{1,2})[:.](\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(am|pm|a\.m\.?|p\.m\.?)?(.*)$"


def _zone_rows(zones: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (zone, year, spans) of every zone; an unknown zone gives none."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) - 2 * 86400
    last = int((datetime(LAST_YEAR + 1, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) + 2 * 86400
    for frame in zones:
        out: list[tuple] = []
        for name in frame["zone"]:
            try:
                zone = ZoneInfo(name)
            except (KeyError, ValueError, OSError):
                continue

            def offset(second: int, zone: ZoneInfo = zone) -> int:
                return int((epoch + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

            starts, at, now = [(first, offset(first))], first, offset(first)
            while at < last:
                step = at + 86400
                if (then := offset(step)) != now:
                    low, high = at, step
                    while high - low > 1:
                        middle = (low + high) // 2
                        low, high = (middle, high) if offset(middle) == now else (low, middle)
                    starts.append((high, then))
                at, now = step, then
            ends = [s for s, _ in starts[1:]] + [last]
            spans = [(s + o, e + o, o) for (s, o), e in zip(starts, ends)]
            k = 0
            for year in range(FIRST_YEAR, LAST_YEAR + 1):
                low = int((datetime(year, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
                high = int((datetime(year + 1, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
                while k < len(spans) - 1 and spans[k][1] <= low:
                    k += 1
                here = [{"lo": a, "hi": b, "off": o} for a, b, o in spans[max(0, k - 1) :] if a < high and b > low]
                out.append((name, year, here))
        yield pd.DataFrame(out, columns=["zone", "year", "spans"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone, year, spans) for the distinct names in `zones.zone`; spans are array<struct<lo,hi,off>> in local seconds."""
    return (
        zones.select(F.col("zone").cast("string").alias("zone")).where(F.col("zone").isNotNull()).distinct()
        .mapInPandas(_zone_rows, "zone string, year int, spans array<struct<lo:bigint,hi:bigint,off:bigint>>")
    )


def _number(part: Column) -> Column:
    return part.try_cast("int")


def _month(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in [*((m, i + 1) for i, m in enumerate(MONTHS_EN)), *MONTHS_HI.items()] for x in (k, v)])
    return F.coalesce(F.try_element_at(table, word), F.try_element_at(table, F.when(word.rlike("^[a-z]+$"), F.substring(word, 1, 3))))


def clean_value(value: Column) -> Column:
    """Lower-cased, spaces squeezed, Devanagari digits as ASCII."""
    digits = F.translate(F.lower(value), "०१२३४५६७८९", "0123456789")
    return F.trim(F.regexp_replace(digits, r"[\s ]+", " "))


def parse_values(values: DataFrame, value: str, month_first: str) -> DataFrame:
    """Add `_day` (date), `_sec` (second of day or null), `_off` (offset in seconds or null), `_instant` (epoch seconds or null)."""
    sep = "\x01"
    swap = F.coalesce(F.col(month_first), F.lit(False))
    text = F.col("_text")
    branch = (
        F.when(text.rlike(r"^\d{10}$|^\d{13}$"), F.lit(None).cast("string"))
        .when(text.rlike(_COMPACT), F.regexp_replace(text, _COMPACT, f"$1{sep}$2{sep}$3{sep} $4:$5:$6$7"))
        .when(text.rlike(_ISO), F.regexp_replace(text, _ISO, f"$1{sep}$2{sep}$3{sep}$4"))
        .when(text.rlike(_NUMERIC), F.when(swap, F.regexp_replace(text, _NUMERIC, f"$3{sep}$1{sep}$2{sep}$4"))
              .otherwise(F.regexp_replace(text, _NUMERIC, f"$3{sep}$2{sep}$1{sep}$4")))
        .when(text.rlike(_DAY_WORD), F.regexp_replace(text, _DAY_WORD, f"$3{sep}$2{sep}$1{sep}$4"))
        .when(text.rlike(_WORD_DAY), F.regexp_replace(text, _WORD_DAY, f"$3{sep}$1{sep}$2{sep}$4"))
    )
    parts = F.col("_parts")
    time = F.col("_time")
    year = F.when(F.length(parts[0]) == 2, F.lit(2000) + _number(parts[0])).otherwise(_number(parts[0]))
    month = F.coalesce(_number(parts[1]), _month(parts[1]))
    hour, half = _number(time[0]), F.substring(time[3], 1, 1)
    zone_word = F.regexp_extract(time[4], r"^[^a-z\d+\-]*([a-z]+|[+\-]\d{2}:?\d{2})", 1)
    zones = F.create_map(*[F.lit(x) for k, v in ZONE_MINUTES.items() for x in (k, v * 60)])
    digits = F.regexp_replace(zone_word, r"[^\d]", "")
    numeric = F.when(F.length(digits) == 4, (_number(F.substring(digits, 1, 2)) * 3600 + _number(F.substring(digits, 3, 2)) * 60) * F.when(zone_word.startswith("-"), -1).otherwise(1))
    out = (
        values.withColumn("_text", clean_value(F.col(value).cast("string")))
        .withColumn("_parts", F.split(branch, sep))
        .withColumn("_time", F.when(parts[3].rlike(_TIME), F.split(F.regexp_replace(parts[3], _TIME, f"$1{sep}$2{sep}$3{sep}$4{sep}$5"), sep)))
        .withColumns({"_y": year, "_m": month, "_d": _number(parts[2]), "_zone_word": zone_word})
        .withColumn("_day", F.format_string("%04d-%02d-%02d", "_y", "_m", "_d").try_cast("date"))
        .withColumn("_clock", F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(F.when(hour.between(0, 23), hour)))
        .withColumn("_minute", F.when(_number(time[1]) < 60, _number(time[1])))
        .withColumn("_second", F.when(time[2] == "", 0).otherwise(F.when(_number(time[2]) < 60, _number(time[2]))))
        .withColumn("_sec", (F.col("_clock") * 3600 + F.col("_minute") * 60 + F.col("_second")).cast("bigint"))
        .withColumn("_off", F.coalesce(F.try_element_at(zones, F.col("_zone_word")), numeric).cast("bigint"))
        .withColumn("_instant", F.when(text.rlike(r"^\d{10}$"), text.try_cast("bigint")).when(text.rlike(r"^\d{13}$"), F.floor(text.try_cast("bigint") / 1000)))
        .withColumn("_timed", time.isNotNull())
    )
    return out.drop("_parts", "_time", "_y", "_m", "_d", "_zone_word", "_clock", "_minute", "_second")


def _utc_text(second: Column) -> Column:
    of_day = F.pmod(second, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60))


def normalise_timestamps(values: DataFrame, value: str = "value", zone: str = "zone", month_first: str = "month_first", zones: DataFrame | None = None) -> DataFrame:
    """Add `status` and `norm` to every row of `values`.

    `zone` is the IANA name for values that carry none; `zones` (column zone) lists the names that may occur, by
    default those of `values`; `month_first` says how numeric dates are read.
    status: date (norm YYYY-MM-DD), instant (norm YYYY-MM-DDTHH:MM:SSZ), ambiguous (two offsets fit; norm is
    the earlier instant), nonexistent (no offset fits; norm null), no_zone (a local time whose zone is null or
    unknown; norm null), invalid (no readable or no possible date, also null, empty and over-long values; norm null).
    Rows are kept one to one, repeated rows too. Columns whose names begin with "_" are reserved.
    """
    origin = F.lit("1970-01-01").cast("date")
    parsed = parse_values(values, value, month_first).withColumns({
        "_local": (F.datediff("_day", origin).cast("bigint") * 86400 + F.col("_sec")),
        "_year": F.year("_day"),
    })
    spans = zone_intervals(values.select(F.col(zone).alias("zone")) if zones is None else zones).select(F.col("zone").alias("_zone"), F.col("year").alias("_span_year"), F.col("spans").alias("_spans"))
    joined = parsed.join(F.broadcast(spans), (parsed[zone] == F.col("_zone")) & (F.col("_year") == F.col("_span_year")), "left")
    hits = F.filter("_spans", lambda s: (s["lo"] <= F.col("_local")) & (F.col("_local") < s["hi"]))
    joined = joined.withColumn("_hits", hits)
    known = F.col("_year").between(FIRST_YEAR, LAST_YEAR)
    status = (
        F.when(F.col("_instant").isNotNull(), "instant")
        .when(F.col("_day").isNull() | ~known, "invalid")
        .when(~F.col("_timed"), "date")
        .when(F.col("_sec").isNull(), "invalid")
        .when(F.col("_off").isNotNull(), "instant")
        .when(F.col("_spans").isNull(), "no_zone")
        .when(F.size("_hits") == 0, "nonexistent")
        .when(F.size("_hits") > 1, "ambiguous")
        .otherwise("instant")
    )
    offset = F.coalesce(F.col("_off"), F.array_max(F.transform("_hits", lambda h: h["off"])))
    second = F.coalesce("_instant", F.col("_local") - offset)
    norm = F.when(F.col("_status").isin("instant", "ambiguous"), _utc_text(second)).when(F.col("_status") == "date", F.col("_day").cast("string"))
    out = joined.withColumn("_status", status).withColumn("_norm", norm)
    return out.select(*[values[c] for c in values.columns if c not in ("status", "norm")], F.col("_status").alias("status"), F.col("_norm").alias("norm"))


def page_dates(raw_items: DataFrame, sources: DataFrame, us_zone: str = "America/New_York") -> DataFrame:
    """(raw_item_id, slot, value, status, norm) of published_date_raw and each value of detected_dates."""
    zones = sources.groupBy(F.col("id").alias("source_id")).agg(F.max("time_zone").alias("zone"))
    slots = F.concat(
        F.array(F.struct(F.lit("published_date_raw").alias("slot"), F.col("published_date_raw").alias("value"))),
        F.coalesce(
            F.transform(
                F.map_entries(F.from_json("detected_dates", "map<string,string>")),
                lambda e: F.struct(F.concat(F.lit("detected_dates."), e["key"]).alias("slot"), e["value"].alias("value")),
            ),
            F.array(),
        ),
    )
    rows = (
        raw_items.select(F.col("id").alias("raw_item_id"), "source_id", F.explode(slots).alias("_s"))
        .select("raw_item_id", "source_id", "_s.slot", "_s.value")
        .where(F.col("value").isNotNull())
        .join(zones, "source_id", "left")
        .withColumn("month_first", F.col("zone") == us_zone)
    )
    return normalise_timestamps(rows, "value", "zone", "month_first", zones.select("zone")).select("raw_item_id", "slot", "value", "status", "norm")
