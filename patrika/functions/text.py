"""Text expressions: squeezing, slugs, keys, tokens, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and blank text."""
    return F.when(F.trim(c) != "", c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_title(c: Column) -> Column:
    return F.lower(squeeze(c))


def content_hash(title: Column, url: Column) -> Column:
    """SHA-256 of the normalised title and the url, a null url as empty."""
    return F.sha2(F.concat_ws("|", norm_title(F.coalesce(title, F.lit(""))), F.coalesce(url, F.lit(""))), 256)


def hyphenate(c: Column) -> Column:
    """Lower case, ASCII letters and digits kept, everything else a single hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slugify(c: Column, most: int = 140) -> Column:
    """Lower case; letters, digits, spaces and hyphens of ASCII kept, runs of spaces as one hyphen, cut to `most`."""
    kept = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s-]", ""))
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"-+", "-"), 1, most)


def stable_slug(name: Column, raw_id: Column, most: int = 120, fallback: str = "job") -> Column:
    """A slug that stays the same for one id: words, then eight digits of the id's SHA-1."""
    base = slugify(name, most)
    return F.concat(F.when(base == "", fallback).otherwise(base), F.lit("-"), F.substring(F.sha1(raw_id), 1, 8))


def short_slug(title: Column, suffix: Column) -> Column:
    """At most 80 characters of hyphenated words, then at most ten of the suffix."""
    return F.concat(F.substring(hyphenate(title), 1, 80), F.lit("-"), F.substring(suffix, 1, 10))


def safe_base(name: Column, most: int = 80) -> Column:
    """The stem of a file name with everything but ASCII letters, digits, hyphens and underscores as underscores; "file" if empty."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    out = F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_-]", "_"), 1, most)
    return F.when(out == "", "file").otherwise(out)


def pdf_text(c: Column) -> Column:
    """Text of a PDF without NULs, carriage returns as line ends, tabs as spaces, at most one blank line in a row."""
    plain = F.translate(F.regexp_replace(c, "\\x00", ""), "\r\t", "\n ")
    return F.regexp_replace(plain, r"\n{3,}", "\n\n")


def canonical_key(source: Column, anchor: Column) -> Column:
    """SHA-256 of the compact JSON object of a source and an anchor."""
    return F.sha2(F.to_json(F.struct(source.alias("source"), anchor.alias("anchor"))), 256)


def dedupe_anchor(kind: Column, title: Column, published: Column, exam: Column, session: Column, detail: Column, pdf: Column) -> Column:
    """What tells an item of a source apart, by the kind of its key: dated title, title, exam with title and session, else its address or title."""
    name, blank = norm_title(F.coalesce(title, F.lit(""))), F.lit("")
    return (
        F.when(kind == "dated", F.concat_ws("::", name, F.coalesce(F.date_format(published, "yyyy-MM-dd"), blank)))
        .when(kind == "titled", name)
        .when(kind == "calendar", F.concat_ws("::", F.coalesce(exam, blank), name, F.coalesce(session, blank)))
        .otherwise(F.coalesce(detail, pdf, name))
    )


def parts(c: Column, marks: str = r"[,;/\n]+") -> Column:
    """The trimmed parts of a list in one text, blank ones dropped."""
    return F.filter(F.transform(F.split(c, marks), lambda x: F.trim(x)), lambda x: x != "")


def size_label(n: Column) -> Column:
    """Bytes as kilobytes in brackets; dashes for none."""
    return F.when(n > 0, F.format_string("(%.2f KB)", n / F.lit(1024.0))).otherwise("--")


def date_label(c: Column) -> Column:
    """A date such as 05 Mar 2026; "Not decided yet" for null."""
    return F.coalesce(F.date_format(c, "dd MMM yyyy"), F.lit("Not decided yet"))


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct lower-case ASCII words of at least `least` characters, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: F.length(t) >= least))


def token_score(a: Column, b: Column) -> Column:
    """Shared tokens over those of the longer side; 0 without tokens."""
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, F.size(F.array_intersect(a, b)) / longer).otherwise(F.lit(0.0))


def detect_year(c: Column) -> Column:
    """The greatest year 20xx stated in the text, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int")))


def short_summary(c: Column, lines: int = 3, most: int = 360) -> Column:
    """The first lines longer than 20 characters that are not page numbers, joined and cut; null if there are none."""
    kept = F.filter(F.transform(F.split(c, r"\n"), lambda x: squeeze(x)), lambda x: (F.length(x) > 20) & ~F.lower(x).rlike(r"^page \d+"))
    return blank_to_null(F.substring(F.array_join(F.slice(kept, 1, lines), " "), 1, most))
