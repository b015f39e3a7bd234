"""Dates against a plain Python reading of each notation."""

import json
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from patrika.operators.timestamps import MONTHS_HI, ZONE_MINUTES, normalise_timestamps, page_dates
from patrika.sources.tables import read_table

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def plain(value, zone):
    """The norm of one value, or None; written without the operator's expressions."""
    s = " ".join(value.translate(str.maketrans("०१२३४५६७८९", "0123456789")).lower().split())
    if re.fullmatch(r"\d{10}|\d{13}", s):
        return datetime.fromtimestamp(int(s[:10]), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    for word, n in MONTHS_HI.items():
        s = s.replace(word, MONTHS[n - 1])
    s = re.sub(r"^(\d{4})(\d\d)(\d\d)(t(\d\d)(\d\d)(\d\d)z)?$", lambda m: f"{m[1]}-{m[2]}-{m[3]}" + (f" {m[5]}:{m[6]}:{m[7]}z" if m[4] else ""), s)
    month = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
    for pattern, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(\d\d?)[-/.](\d\d?)[-/.](\d{4}|\d\d)\b", "mdy" if zone == "America/New_York" else "dmy"),
                           (rf"(\d\d?)(?:st|nd|rd|th)?[ -]{month},?[ -](\d{{4}}|\d\d)\b", "dmy"), (rf"\b{month} (\d\d?),? (\d{{4}})", "mdy")):
        if m := re.search(pattern, s):
            g = dict(zip(order, m.groups()))
            y, mo, d = int(g["y"]), MONTHS.index(g["m"]) + 1 if g["m"] in MONTHS else int(g["m"]), int(g["d"])
            try:
                day = datetime(y + 2000 if y < 100 else y, mo, d)
            except ValueError:
                return None
            rest = s[m.end() :]
            t = re.search(r"(\d\d?)[:.](\d\d)(?::(\d\d))?(?:\.\d+)? ?(a|p)?", rest)
            if not t:
                return day.strftime("%Y-%m-%d")
            hour = int(t[1]) % 12 + (12 if t[4] == "p" else 0) if t[4] else int(t[1])
            local = day + timedelta(hours=hour, minutes=int(t[2]), seconds=int(t[3] or 0))
            z = re.search(r"([+-])(\d\d):?(\d\d)\b|\b(" + "|".join(ZONE_MINUTES) + r")\b|\d(z)$", rest[t.end() - 1 :])
            if z and z[1]:
                minutes = (int(z[2]) * 60 + int(z[3])) * (-1 if z[1] == "-" else 1)
            elif z:
                minutes = ZONE_MINUTES[z[4] or "z"]
            else:
                if not zone:
                    return None
                minutes = local.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds() / 60
                back = (local - timedelta(minutes=minutes)).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None)
                if back != local:
                    return None
            return (local - timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return None


def test_tables_match_plain_reading(spark):
    folder = "/root/testdata/sf0.01"
    pages, sources = read_table(spark, folder, "raw_items"), read_table(spark, folder, "sources")
    got = {(r.raw_item_id, r.slot, r.norm) for r in page_dates(pages, sources).collect() if r.norm}
    zones = {r.id: r.time_zone for r in sources.collect()}
    want = set()
    for r in pages.collect():
        slots = {"published_date_raw": r.published_date_raw} | {f"detected_dates.{k}": v for k, v in json.loads(r.detected_dates or "{}").items()}
        want |= {(r.id, k, n) for k, v in slots.items() if v is not None and (n := plain(str(v), zones.get(r.source_id)))}
    assert got == want


CASES = [
    ("2021-11-07 01:30:00", "America/New_York", "ambiguous", "2021-11-07T05:30:00Z"),
    ("2021-03-14 02:30", "America/New_York", "nonexistent", None),
    ("2021-06-01 10:00", "America/New_York", "instant", "2021-06-01T14:00:00Z"),
    ("03/04/2021", "America/New_York", "date", "2021-03-04"),
    ("03/04/2021", "Asia/Kolkata", "date", "2021-04-03"),
    ("10:00 2021", "Asia/Kolkata", "invalid", None),
    ("2021-06-01 10:00", None, "no_zone", None),
    ("2021-06-01 10:00", "Mars/Base", "no_zone", None),
    ("2021-06-01T10:00:00.123Z", None, "instant", "2021-06-01T10:00:00Z"),
    ("31/02/2025", "Asia/Kolkata", "invalid", None),
    ("00/00/0000", "Asia/Kolkata", "invalid", None),
    ("2021-06-01 25:00", "Asia/Kolkata", "invalid", None),
    ("13.05 pm 2021-06-01", "Asia/Kolkata", "date", "2021-06-01"),
    ("", "Asia/Kolkata", "invalid", None),
    (None, "Asia/Kolkata", "invalid", None),
    ("x" * 100_000, "Asia/Kolkata", "invalid", None),
    ("29 फरवरी 2024", "Asia/Kolkata", "date", "2024-02-29"),
    ("29/02/2023", "Asia/Kolkata", "invalid", None),
    ("1583020800", None, "instant", "2020-03-01T00:00:00Z"),
]


def test_cases(spark):
    rows = [(i, v, z, z == "America/New_York") for i, (v, z, _, _) in enumerate(CASES)] * 2
    out = normalise_timestamps(spark.createDataFrame(rows, "i int, value string, zone string, month_first boolean")).collect()
    assert len(out) == len(rows)
    got = {r.i: (r.status, r.norm) for r in out}
    for i, (value, _, status, norm) in enumerate(CASES):
        assert got[i] == (status, norm), value and value[:50]


def test_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "2021-01-02", "UTC", None, "kept", 5)], "year int, value string, zone string, month_first boolean, status string, lo int")
    row = normalise_timestamps(frame).collect()[0]
    assert (row.status, row.norm, row.year, row.lo) == ("date", "2021-01-02", 1, 5)
    assert normalise_timestamps(frame.limit(0)).count() == 0


if __name__ == "__main__":
    pytest.main([__file__, "-q"])
