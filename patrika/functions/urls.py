"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without "www."; a missing scheme is supplied; null for what is no URL."""
    text = F.trim(url)
    whole = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("http://"), text))
    found = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"^www\.", ""))


def http_url(url: Column) -> Column:
    """The URL without wrapping punctuation if it is http or https, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[<(\[\"']+", ""), r"[>)\]\"'.,;]+$", "")
    return F.when(F.lower(bare).rlike(r"^https?://[^\s/]+"), bare)


def absolute(url: Column, base: Column) -> Column:
    """`url` resolved against `base`: absolute, protocol-relative, rooted or relative to the base's folder; fragments and script links are null."""
    u = F.trim(url)
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]+(?:/[^?#]*)?/)", 1)
    return (
        F.when((u == "") | u.startswith("#") | F.lower(u).rlike(r"^(javascript|mailto|tel|data):"), None)
        .when(F.lower(u).rlike(r"^https?://"), u)
        .when(u.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), u))
        .when(root == "", None)
        .when(u.startswith("/"), F.concat(root, u))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), u))
    )


def host_suffixes(name: Column) -> Column:
    """A host and its parent domains, the host first: a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_document(url: Column) -> Column:
    """Whether an address is that of a PDF."""
    return F.coalesce(url.rlike(r"(?i)\.pdf(?:[/?]|$)"), F.lit(False))


def first_url(*candidates: Column) -> Column:
    """The first candidate that is not blank, trimmed; empty if all are."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in candidates], F.lit(""))


def ensure_absolute(url: Column, base: Column) -> Column:
    """An absolute address as it is, a rooted one on the base, "www." under https; else empty."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    root = F.regexp_extract(F.coalesce(base, F.lit("")), r"^(https?://[^/?#]+)", 1)
    return F.when(raw.rlike("^https?://"), raw).when(raw.startswith("/") & (root != ""), F.concat(root, raw)).when(raw.startswith("www."), F.concat(F.lit("https://"), raw)).otherwise("")


def official(url: Column, domains: list[str]) -> Column:
    """Whether the host of an address is one of the domains or below one (a short list; longer ones are joined)."""
    name = F.regexp_extract(F.lower(url), r"^https?://(?:[^/@?#]*@)?([^/:?#\s]+)", 1)
    return F.exists(host_suffixes(name), lambda part: part.isin(domains))


def urls_of_text(text: Column, domains: list[str]) -> Column:
    """The different official addresses in a text, those with a scheme first, in order: full ones, and bare ones of the domains under https."""
    listed = "|".join(d.replace(".", r"\.") for d in domains)
    full = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(https?://[^\s\"'<>]+)"), F.lit(1))
    bare = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b((?:https?://)?(?:www\.)?(?:{listed})(?:/[^\s\"'<>]*)?)"), F.lit(1))
    schemed = F.transform(F.concat(full, bare), lambda u: F.when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))
    return F.array_distinct(F.filter(F.transform(schemed, http_url), lambda u: u.isNotNull() & official(u, domains)))


def attachment_path(path: Column) -> Column:
    """The segments of a path, percent-encoded, joined by slashes; backslashes count as slashes."""
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    return F.array_join(F.transform(segments, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")


def title_of_url(url: Column) -> Column:
    """The last segment of an address as a title: decoded, without its extension, plus signs and underscores as spaces."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    segment = F.regexp_extract(path, r"([^/]+)/*$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, r"(?i)\.[a-z0-9]+$", ""), r"[+_]", " "), r"\s+", " "))


def client_key(forwarded: Column, peer: Column) -> Column:
    """Who asks: the first forwarded address, else the peer's, else "unknown"."""
    return F.coalesce(F.when(forwarded != "", F.trim(F.split(forwarded, ",")[0])), peer, F.lit("unknown"))
