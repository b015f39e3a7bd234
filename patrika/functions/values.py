"""Dates, amounts and counts out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two ways in which a count of posts is stated.
VACANCIES = [r"(?i)(\d{1,3}(?:,\d{3})+|\d+)\s*(?:posts?|vacancies|vacancy)", r"(?i)(?:total\s+)?vacanc(?:y|ies)\s*[:\-]?\s*(\d{1,3}(?:,\d{3})+|\d+)"]
_DMY = r"(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})"


def strict_date(c: Column) -> Column:
    """The first day-month-year of the text; null if it is no date."""
    p = lambda k: F.regexp_extract(c, _DMY, k)
    return F.when(p(0) != "", F.concat_ws("-", p(3), F.lpad(p(2), 2, "0"), F.lpad(p(1), 2, "0")).try_cast("date"))


def rolling_date(c: Column) -> Column:
    """As strict_date, but days and months beyond their range roll over: 31-02-2026 is 3 March 2026."""
    p = lambda k: F.regexp_extract(c, _DMY, k).try_cast("int")
    start = F.concat(F.regexp_extract(c, _DMY, 3), F.lit("-01-01")).try_cast("date")
    return F.when(p(3) > 0, F.date_add(F.add_months(start, p(2) - 1), p(1) - 1))


def first_amount(c: Column) -> Column:
    """The first number of the text, thousands commas dropped; 0 where it says nil, free or exempted; else null."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r",", "")
    number = F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")
    return F.coalesce(number, F.when(F.lower(text).rlike(r"\b(nil|free|exempted|no fee)\b"), F.lit(0).cast("bigint")))


def vacancy_count(c: Column) -> Column:
    """The number before "posts" or "vacancies", with or without a space, else after "vacancies"; null without one."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(*[F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("bigint") for p in VACANCIES])


def age_range(c: Column) -> tuple[Column, Column]:
    """(least, most) of an age span such as "18-35 years", "18 to 35" or "Min 18, Max 35"."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1))
    number = lambda k: F.try_element_at(found, F.lit(k)).try_cast("int")
    return number(1), number(2)
