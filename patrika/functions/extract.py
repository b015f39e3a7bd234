"""Dates, fees, counts, ages and labelled lines out of the text of notices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from patrika.functions.text import squeeze

# Patterns of dates and of the facts beside them; results must equal those of the same patterns elsewhere.
DATE_TOKEN = r"(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CLOSING = [rf"(?i)(?:last\s+date\s*(?:to\s*apply)?|closing\s+date|end\s+date)[^\n]{{0,40}}?\b({DATE_TOKEN})", rf"(?i)\b(?:upto|up to|before|till)[^\n]{{0,20}}?\b({DATE_TOKEN})"]
SALARY = [r"(?i)(Rs\.?\s*\d[\d,]*\s*(?:-|to)\s*Rs\.?\s*\d[\d,]*)", r"(?i)(Rs\.?\s*\d[\d,]*\s*(?:-|to)\s*\d[\d,]*)", r"(?i)(\d[\d,]*\s*(?:-|to)\s*\d[\d,]*\s*(?:per\s+month|pm|p\.m\.))"]
PAY_LEVEL = [r"(?i)(level\s*[-:]?\s*\d{1,2}[a-zA-Z]?)"]
FEE = [r"(?i)(?:application\s+fee|fee)\s*[:\-]?\s*(Rs\.?\s*\d[\d,]*)", r"(?i)(?:application\s+fee|fee)\s*[:\-]?\s*(?:INR\s*)?(\d[\d,]*)"]
VACANCY_TOTAL = [r"(?i)(?:total\s+vacanc(?:y|ies)|total\s+post(?:s)?|vacancy\s+details\s+total)[^\d]{0,20}([\d,]{1,9})", r"(?i)\bno\.\s*of\s*vacanc(?:y|ies)\b[^\n\r]{0,140}\btotal\b[^\d]{0,20}([\d,]{1,9})", r"(?i)([\d,]{4,9})\s+posts?"]
NO_MONEY = r"(?i)nil|no fee|free|not required"
ZERO_TOKEN = r"(?i)--|nil|na|n/a"
FEE_CATEGORIES = {"general": r"\b(?:general|gen|obc|ews)\b", "obc": r"\bobc\b", "sc_st": r"\b(?:sc|st)\b", "disabled": r"\b(?:ph|pwd|pwbd|disab(?:led|ility)?)\b", "female": r"\b(?:female|women)\b"}
AGE_RANGE, AGE_MIN, AGE_MAX = r"(?i)age\s*limit[^\n]{0,80}?(\d{1,2})\s*(?:-|to)\s*(\d{1,2})", r"(?i)(?:minimum|min)\s*age[^\d]{0,10}(\d{1,2})", r"(?i)(?:maximum|max)\s*age[^\d]{0,10}(\d{1,2})"
LINE_VALUES = {
    "qualification": [r"(?i)\beducation\s*[:\-]\s*([^\n\r]{8,260})", r"(?i)(?:essential\s+qualification|qualification\s+required)\s*[:\-]?\s*([^\n\r]{8,260})"],
    "pay_scale": [r"(?i)(?:monthly\s+remuneration(?:\s+payable)?|annual\s+ctc(?:\s+range)?|pay\s+scale|pay\s+level)\s*[:\-]?\s*([^\n\r]{5,220})"],
    "centres": [r"(?i)(?:exam(?:ination)?\s+cent(?:re|er)s?)\s*[:\-]?\s*([^\n\r]{5,260})"],
}
REJECTED = r"(?i)\b(?:https?://|www\.)|\b(?:click here|home page|download notification|see detailed advertisement|candidates? are requested)\b|\b(?:advertisement no|page \d+ of \d+)\b"
PAY_WORDS = r"(?i)\d|rs\.?|₹|\binr\b|\bctc\b|\bpay\b|\blevel\b|\bremuneration\b|\bsalary\b"
TEXT_NUMBER = r"(?i)^(?:nil|na|n/a|none|not\s+mentioned|not\s+available)$"


def nonempty(c: Column) -> Column:
    """Null for null and empty text."""
    return F.when(c != "", c)


def first_match(c: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that is found; null if none is."""
    return F.coalesce(*[nonempty(F.regexp_extract(c, p, 1)) for p in patterns])


def rolled(year: Column, month: Column, day: Column) -> Column:
    """A date whose day and month may lie beyond their range; they roll over."""
    start = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-01")).try_cast("date")
    return F.date_add(F.add_months(start, month - 1), day - 1)


def parse_date(c: Column) -> Column:
    """A date of figures (day first, two-digit years in this century, rolling over) or with an English month; null for another."""
    token = F.regexp_replace(F.trim(c), r",$", "")
    plain = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$"
    number = lambda p, k: F.regexp_extract(token, p, k).try_cast("int")
    year = F.when(number(plain, 3) < 100, number(plain, 3) + 2000).otherwise(number(plain, 3))
    month = lambda p, k: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(token, p, k), 1, 3))).cast("int")
    before, after = r"^(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})$", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$"
    worded = lambda p, d, m: F.when((month(p, m) > 0) & number(p, d).between(1, 31), rolled(number(p, 3), month(p, m), number(p, d)))
    return F.coalesce(F.when(number(plain, 3).isNotNull(), rolled(year, number(plain, 2), number(plain, 1))), worded(before, 1, 2), worded(after, 2, 1))


def first_date(c: Column, patterns: list[str]) -> Column:
    """The date of the first pattern whose group can be read."""
    return F.coalesce(*[parse_date(F.regexp_extract(c, p, 1)) for p in patterns])


def strict_dates(c: Column) -> Column:
    """The different valid dates d/m/y or d-m-y in order of appearance."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"), F.lit(1))
    part = lambda t, k: F.lpad(F.split(t, "[/-]")[k], 2, "0")
    dates = F.transform(tokens, lambda t: F.concat_ws("-", F.split(t, "[/-]")[2], part(t, 1), part(t, 0)).try_cast("date"))
    return F.array_distinct(F.filter(dates, lambda d: d.isNotNull()))


def rolling_dates(c: Column) -> Column:
    """The different dates d.m.y, d/m/y or d-m-y in order of appearance, rolling over."""
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d{1,2}[./-]\d{1,2}[./-]\d{4})"), F.lit(1))
    return F.array_distinct(F.transform(tokens, parse_date))


def session_of(year: Column) -> Column:
    """2026 as 2026-27."""
    return F.when(year > 0, F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")))


def money(c: Column) -> Column:
    """The first number of a snippet, else 0 where it says that none is due, else null."""
    number = F.regexp_replace(F.regexp_extract(c, r"(\d{1,3}(?:,\d{3})+|\d+)", 1), ",", "").try_cast("bigint")
    return F.coalesce(number, F.when(c.rlike(NO_MONEY), F.lit(0).cast("bigint")))


def fee_area(c: Column) -> Column:
    """The lines that say "fee", each with the two after it."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    says = lambda x: F.coalesce(x.rlike(r"(?i)\bfee\b"), F.lit(False))
    near = lambda i, k: F.when(i >= k, says(F.get(lines, i - k))).otherwise(False)
    return F.array_join(F.filter(lines, lambda x, i: says(x) | near(i, 1) | near(i, 2)), "\n")


def amount_for(area: Column, category: str) -> Column:
    """The first amount that follows the category within 120 characters of its line."""
    snippets = F.regexp_extract_all(area, F.lit(rf"(?i)({category}[^\n]{{0,120}})"), F.lit(1))
    return F.get(F.filter(F.transform(snippets, money), lambda m: m.isNotNull()), F.lit(0))


def int_token(c: Column) -> Column:
    """A count as printed in a table: 0 for a dash or "nil", else its digits; null without any."""
    return F.when(c == "", None).when(c.rlike(ZERO_TOKEN), F.lit(0).cast("bigint")).otherwise(F.regexp_replace(c, r"[^\d]", "").try_cast("bigint"))


def category_vacancies(c: Column) -> Column:
    """struct<sc, st, obc, ews, general, total>: counts of the best "Total" line of five figures or more; null without one.

    A line with six figures or more has EWS as its fourth. A later line is better if its figures add up and those before it do not, or if
    its total is greater.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)^total\b"))
    figures = F.filter(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(\d+|--)"), F.lit(1)), int_token)), lambda t: F.size(t) >= 5)

    def counts(t: Column) -> Column:
        six = F.size(t) >= 6
        return F.struct(t[0].alias("sc"), t[1].alias("st"), t[2].alias("obc"), F.when(six, t[3]).alias("ews"), F.when(six, t[4]).otherwise(t[3]).alias("general"), F.when(six, F.get(t, F.lit(5))).otherwise(t[4]).alias("total"))

    rows = F.transform(figures, counts)
    zero = lambda x: F.coalesce(x, F.lit(0))
    added = lambda r: reduce(lambda a, b: a + b, [zero(r[k]) for k in ("sc", "st", "obc", "ews", "general")])
    sound = lambda r: (zero(r["total"]) > 0) & (added(r) > 0)
    better = lambda best, r: sound(r) & (F.abs(added(r) - zero(r["total"])) <= 2) & ~sound(best) | (zero(r["total"]) > zero(best["total"]))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.get(rows, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best)))


def vacancy_total(c: Column, counts: Column) -> Column:
    """The stated total of the categories, else their sum, else the first number beside "total vacancies" or "posts"."""
    added = reduce(lambda a, b: a + b, [F.coalesce(counts[k], F.lit(0)) for k in ("sc", "st", "obc", "ews", "general")])
    stated = [F.regexp_replace(F.regexp_extract(c, p, 1), ",", "").try_cast("bigint") for p in VACANCY_TOTAL]
    return F.coalesce(F.when(counts["total"] > 0, counts["total"]), F.when(added > 0, added), *[F.when(n > 0, n) for n in stated])


def stated_ages(c: Column) -> tuple[Column, Column]:
    """(least, most): the span after "age limit", else the numbers after "minimum age" and "maximum age"."""
    number = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    ranged = number(AGE_RANGE, 1).isNotNull()
    return F.when(ranged, number(AGE_RANGE, 1)).otherwise(number(AGE_MIN, 1)), F.when(ranged, number(AGE_RANGE, 2)).otherwise(number(AGE_MAX, 1))


def inline(c: Column) -> Column:
    """A value squeezed, without marks at its start; null if nothing is left."""
    return nonempty(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[:\-.\s]+", "")))


def line_value(c: Column, patterns: list[str]) -> Column:
    """The rest of the line after the first label that has one."""
    return F.coalesce(*[inline(F.regexp_extract(c, p, 1)) for p in patterns])


def sanitized(c: Column, most: int, reject: str = REJECTED, require: str | None = None) -> Column:
    """A value squeezed; null if it is blank, longer than `most`, holds what is rejected or lacks what is required."""
    text = squeeze(c)
    keep = (text != "") & (F.length(text) <= most) & ~text.rlike(reject)
    return F.when(keep & text.rlike(require) if require else keep, text)


def to_number(c: Column) -> Column:
    """A number out of text: 0 for words that say none, else digits, points and signs read as one number; null if that is none."""
    text = F.trim(c)
    return F.when(text.rlike(TEXT_NUMBER), F.lit(0.0)).otherwise(nonempty(F.regexp_replace(text, r"[^\d.\-]", "")).try_cast("double"))


def bounded(c: Column, least: float, most: float) -> Column:
    """The number if it lies within the bounds."""
    return F.when(c.between(least, most), c)


def clamp(c: Column, digits: int = 3) -> Column:
    """Brought into 0..1 and rounded."""
    return F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), digits)


# Bounds of the numbers of a record; a value outside them is none.
BOUNDS = {"age_min": (14, 80), "age_max": (14, 100), "vacancies": (1, 1_000_000), "fee": (0, 1_000_000), "confidence": (0, 1)}


def read_details(c: Column, numbers: dict[str, tuple[float, float]], texts: list[str], dates: list[str]) -> Column:
    """A record out of JSON: numbers within their bounds, squeezed texts, dates; null if the JSON cannot be read or no field has a value."""
    read = F.from_json(c, "map<string,string>")
    fields = [bounded(to_number(read[n]), *b).alias(n) for n, b in numbers.items()] + [nonempty(squeeze(read[n])).alias(n) for n in texts] + [parse_date(squeeze(read[n])).alias(n) for n in dates]
    found = reduce(lambda a, b: a | b, [f.isNotNull() for f in fields])
    return F.when(read.isNotNull() & found, F.struct(*fields))
