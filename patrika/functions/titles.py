"""Names of recruitments out of titles and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patrika.functions.text import squeeze

# Patterns of what a title says beside its name; results must equal those of the same patterns elsewhere.
CALLS = r"(?i)click\s*here|download|\bnotice\b|\badvertisement\b|\badvt\.?\b"
TAIL = r"[|:_-]+\s*$"
BRACKETED = r"(?i)\([^)]*(?:apply|online|registration|extended|corrigendum|advt|advertisement|crpd/|from\s+\d{1,2}[./-]|to\s+\d{1,2}[./-])[^)]*\)|\((?:new|updated)\)"
TRAILING = r"(?i)\b(?:advertisement|advt)\s*no\.?\s*[:\-]?\s*[a-z0-9/.-]+|\b(?:online\s+registration|apply\s+online|online\s+application)[^.,;)]*|\b(?:has\s+been\s+extended|extended\s+till)[^.,;)]*"
LEADING = r"(?i)^\s*(?:engagement|recruitment)\s+of\s+|^\s*for\s+the\s+post\s+of\s+"
NAMED = r"(?i)\b(?:recruitment|engagement|examination|exam|vacancy|post|officer|assistant|constable|cadre)\b"
META = r"(?i)\b(?:apply|registration|extended|corrigendum|notification|advt|advertisement\s+no)\b"
HEADER = r"(?i)^page\s*\d+|\b(?:phone|email|corporate\s+centre|central\s+recruitment|state\s+bank\s+of\s+india)\b|^(?:s\.?\s*no\.?|sr\.?\s*no\.?)\b"
NO_NAME = r"(?i)^(?:to|for|which|that|whose)\b|\b(?:subject\s+to|with\s+effect|as\s+per|to\s+which|hereby|thereof)\b"
HINT_WORDS = r"\b(?:result|merit|selected|selection list|provisional list|declaration|cut[-\s]?off|admit card|hall ticket|answer key|corrigendum|corrigenda|extension|extended|notice|notification|revised|tainted candidates)\b"
ACRONYMS = ["SBI", "SSC", "UPSC", "GDS", "CGL", "CHSL", "MTS", "CPO", "JE"]
MENU = r"(?i)^(?:home|about us|contact|downloads?)$|^(?:calendar|examination calendar|active examinations|forthcoming examinations|previous question papers|cut[- ]?off marks|answer keys?|marks of recommended candidates(?: \(reserve list\))?|revised syllabus and scheme|demo files)$"
ASIDE = r"(?i)question papers|cut[- ]?off|answer keys?|marks of recommended|representation on question papers|specimen question|common mistakes|copyright|skip to main content|screen reader"
EXAM = r"(?i)exam|examination|recruitment|service|test|combined|engineering|medical|defence|nda|cds|civil"


def raw_title(c: Column) -> Column:
    """A title without calls to act and marks at its end."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), CALLS, ""), TAIL, ""))


def without_meta(c: Column) -> Column:
    """A title without bracketed remarks, numbers of advertisements and what follows an invitation to apply."""
    bare = F.regexp_replace(F.regexp_replace(c, BRACKETED, ""), TRAILING, "")
    return F.regexp_replace(F.regexp_replace(bare, TAIL, ""), r"[.,;:]\s*$", "")


def title_case(c: Column) -> Column:
    """Every word of letters, digits and underscores begins with a capital, the rest is lower case."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+|[^a-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def acronyms(c: Column) -> Column:
    """Known acronyms in capitals where title case lowered them."""
    for name in ACRONYMS:
        c = F.regexp_replace(c, rf"\b{name.capitalize()}\b", name)
    return c


def is_likely_name(c: Column) -> Column:
    """Whether a text may be the name of a recruitment: 6 to 180 characters with a letter, no subordinate clause."""
    text = squeeze(F.coalesce(c, F.lit("")))
    return F.length(text).between(6, 180) & ~text.rlike(NO_NAME) & text.rlike("[A-Za-z]")


def detect_year(c: Column) -> Column:
    """The greatest year 20xx, or end of a span such as 2025-26 of five years at most; null without one."""
    text = F.coalesce(c, F.lit(""))
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    span = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\s*[-/]\s*\d{2}\b"), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(r"\b20\d{2}\s*[-/]\s*(\d{2})\b"), F.lit(1)).alias("b"))
    ends = F.transform(span, lambda s: F.struct(s["a"].cast("int").alias("a"), (F.floor(s["a"].cast("int") / 100) * 100 + s["b"].cast("int")).cast("int").alias("b")))
    return F.array_max(F.concat(single, F.transform(F.filter(ends, lambda s: s["b"].between(s["a"], s["a"] + 5)), lambda s: s["b"])))


def exam_name(title: Column, source_text: Column, organization: Column, preferred: Column) -> Column:
    """The name of a recruitment: the preferred title if it may be one, else the title, else the text; cleaned, with its year."""
    wanted = F.when(is_likely_name(preferred), squeeze(preferred))
    year = F.coalesce(detect_year(wanted), detect_year(source_text), detect_year(title))
    nonempty = lambda c: F.when(c != "", c)
    base = F.coalesce(nonempty(wanted), nonempty(title), source_text)
    # the two openings are taken off one after the other
    opened = F.regexp_replace(F.regexp_replace(raw_title(base), r"(?i)^\s*(?:engagement|recruitment)\s+of\s+", ""), r"(?i)^\s*for\s+the\s+post\s+of\s+", "")
    cleaned = squeeze(without_meta(opened))
    compact = F.coalesce(nonempty(cleaned), nonempty(raw_title(source_text)), F.concat(organization, F.lit(" Recruitment")))
    cased = F.when(compact.rlike("[A-Z]{6,}"), title_case(compact)).otherwise(compact)
    named = F.when(~cased.rlike(r"\b20\d{2}\b") & year.isNotNull(), F.concat(cased, F.lit(" "), year.cast("string"))).otherwise(cased)
    return squeeze(acronyms(named))


def heading_score(line: Column) -> Column:
    """How much a line looks like a heading that names a recruitment."""
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    return one(F.length(line).between(12, 180), 1) + one(line.rlike(NAMED), 4) - one(line.rlike(META), 2) - one(line.rlike(HEADER), 4)


def best_heading(c: Column, lines: int = 80) -> Column:
    """The line of the highest score among the first `lines`, the first of equals; the first line if none scores; null without lines."""
    kept = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: squeeze(x)), lambda x: x != ""), 1, lines)
    best = F.array_max(F.transform(kept, lambda x, i: F.struct(heading_score(x).alias("score"), (-i).alias("at"), x.alias("line"))))
    return F.when(best["score"] >= 1, best["line"]).otherwise(F.get(kept, F.lit(0)))


def hint_title(c: Column) -> Column:
    """A title brought down to what a related one shares: no words of status, no dates, no marks."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), HINT_WORDS, " "), r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", " ")
    return squeeze(F.regexp_replace(bare, r"[^a-z0-9\s]", " "))


def is_likely_exam(c: Column) -> Column:
    """Whether a label names an examination rather than an entry of a menu."""
    text = F.coalesce(c, F.lit(""))
    return F.length(text).between(10, 220) & ~text.rlike(MENU) & ~text.rlike(ASIDE) & (text.rlike(EXAM) | text.rlike(r"\b20\d{2}\b"))


def agency(key: Column, prefixes: dict[str, str], other: str) -> Column:
    """The agency that a key's prefix stands for."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(key.startswith(prefix), name).otherwise(out)
    return out
