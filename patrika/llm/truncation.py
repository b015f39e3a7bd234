"""Texts cut off before their end, and how often each source cuts.

A stack automaton reads each whole text once. Every sentence, bracket, quote and element is put on its stack where it opens
and taken off where it closes; an escape, a tag or a multibyte sequence that the end breaks stays on top. What is left on the stack is what
the text leaves open, and a text with an empty stack is whole. Whether an open sentence means a cut is not a matter of the text alone,
since lists, tables and signatures end without a terminator. It is decided from the corpus: for each sentence opening, the share
of its sentences that end with a terminator. An open end whose opening nearly always leads to a terminated sentence
was cut. For openings that go either way, the bar moves with the baseline of the source, the share of its texts that are cut
for certain, and an open bracket, quote or element lowers it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.session import cut_lineage

# Marks that a cut leaves behind, apart from U+FFFD.
CUT_MARKS = r"(?:…|\.\.\.|\[(?:more|\.\.\.|…|cut|truncated|contd\.?)\]|\((?:more|\.\.\.|…|truncated|contd\.?)\)|(?:read|show|see) more|>>+|»)"

_MARK_END = re.compile(rf"[\s]*({CUT_MARKS})\s*$", re.I)
_ESCAPE_END = re.compile(r"&(?:(?-i:[a-z]{1,6})|#x?[0-9a-f]{0,5})$|%[0-9a-f]?$|\\(?:u[0-9a-f]{0,3}|x[0-9a-f]?)?$", re.I)
_TAG_END = re.compile(r"<(?:!-{0,2}|[/!]?[a-z][a-z0-9]*(?:\s+[a-z-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*(?:\s+[a-z-]+\s*=\s*(?:\"[^\"]*|'[^']*)?)?\s*/?)$", re.I)
_WRAP = re.compile(r"(?<=[a-z,ऀ-ॿ-])\n(?=[a-z])")
_UNIT = re.compile(r"(?<=[.?!])([\"')\]]*)[ \t]+(?=[A-Zऀ-ॿ\"'(])|(?<=।)[ \t]+|\s*\n\s*")
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:rs|no|dr|shri|smt|advt|govt|dt|sr|jr|a\.m|p\.m|st|dept|art|sec)\.$|^\(?\d{1,3}\.$", re.I)
_DIGITS = re.compile(r"\d+")
_SIGNED = re.compile(r"\s*sd/?-", re.I)
_MARKS = re.compile(r"[()\[\]{}“”\"]|<(/?)([a-z][a-z0-9]*)(?:\s[^<>]*)?>", re.I)
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“"}
# Elements that need an end tag.
_ENDING = {"a", "b", "i", "u", "em", "strong", "span", "small", "sup", "sub", "div", "table", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "form", "font", "center"}

_SCHEMA = "kind string, doc_id bigint, source string, key1 string, key2 string, key3 string, n bigint, ended bigint, words int, flags int"
#: What an end leaves open, as bits of `flags`.
MARKED, BROKEN, OPEN_BRACKET, UNENDED, AFTER_SENTENCE, SIGNED, SAME_LINE = 1, 2, 4, 8, 16, 32, 64


class StackAutomaton:
    """Reads a text sentence by sentence; `stack` is what is open.

    A closer takes off the last opener of its kind, since quotes and elements cross brackets; one without an opener is skipped. A straight
    quote opens only before a word and not after one, which leaves out inches and ditto marks.
    """

    SENTENCE, ESCAPE, TAG, BYTES = "sentence", "escape", "tag", "bytes"

    def __init__(self) -> None:
        self.stack: list[str] = []

    def close(self, symbol: str) -> bool:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == symbol:
                del self.stack[k]
                return True
        return False

    def read(self, unit: str) -> None:
        """One sentence or line, left open."""
        self.stack.append(self.SENTENCE)
        for m in _MARKS.finditer(unit):
            c = m.group()
            if c == '"':
                if not self.close(c) and not unit[m.start() - 1 : m.start()].isalnum() and unit[m.end() : m.end() + 1].strip():
                    self.stack.append(c)
            elif name := m.group(2):
                name = name.lower()
                if name in _ENDING and not c.endswith("/>"):
                    if m.group(1):
                        self.close(name)
                    else:
                        self.stack.append(name)
            elif c in _PAIRS:
                self.close(_PAIRS[c])
            else:
                self.stack.append(c)

    def end_sentence(self) -> None:
        self.close(self.SENTENCE)

    def end_text(self, body: str, broken: bool) -> None:
        """What the end of the text breaks stays on top of the stack."""
        if broken:
            self.stack.append(self.BYTES)
        tag = body.rfind("<")
        if tag >= 0 and _TAG_END.match(body, tag):
            self.stack.append(self.TAG)
        elif _ESCAPE_END.search(body, max(0, len(body) - 12)):
            self.stack.append(self.ESCAPE)

    def flags(self) -> int:
        left = set(self.stack)
        broken = left & {self.BYTES, self.TAG, self.ESCAPE}
        out = (BROKEN if broken else 0) | (UNENDED if self.SENTENCE in left else 0)
        return out | (OPEN_BRACKET if left - broken - {self.SENTENCE} else 0)


def open_brackets(text: str) -> int:
    """Brackets, quotes and elements still open at the end."""
    automaton = StackAutomaton()
    automaton.read(text)
    automaton.end_sentence()
    return len(automaton.stack)


def _keys(unit: str) -> list[str]:
    words = _DIGITS.sub("9", " ".join(unit.split(None, 3)[:3]).lower()).split(" ")
    return [" ".join(words[: k + 1]) for k in range(len(words))]


def _ended(unit: str) -> bool:
    return unit.rstrip("\"')]")[-1:] in (".", "?", "!", "।")


def sentences(body: str) -> list[str]:
    """The sentences and lines of a text, closers with the sentence that they end; wrapped lines are one."""
    text = _WRAP.sub(" ", body)
    units, held, at = [], "", 0
    spans = [(m.end(1) if m.group(1) else m.start(), m.end()) for m in _UNIT.finditer(text)]
    for stop, after in [*spans, (len(text), len(text))]:
        unit, at = text[at:stop], after
        held = f"{held} {unit}" if held else unit
        if not _ABBREVIATED.search(held if len(held) < 12 else f" {held[-11:]}"):
            units.append(held)
            held = ""
    if held:
        units.append(held)
    return [u for u in units if u] or [""]


def read_text(text: str) -> tuple[list[str], int, str]:
    """(sentences, flags, the text without cut marks): one pass of the automaton over a whole text."""
    marked, body = 0, text.rstrip()
    broken = body.endswith("�") or any("\ud800" <= c <= "\udfff" for c in body[-1:])
    if broken:
        body = body.rstrip("�").rstrip()
    # the longest mark has 12 characters but for a row of ">"
    while m := _MARK_END.search(body, max(0, len(body.rstrip(">")) - 14)):
        marked = MARKED
        body = body[: m.start()].rstrip()
    automaton = StackAutomaton()
    units = sentences(body)
    for unit in units[:-1]:
        automaton.read(unit)
        automaton.end_sentence()
    automaton.read(units[-1])
    if _ended(units[-1]):
        automaton.end_sentence()
    automaton.end_text(body, broken)
    flags = marked | automaton.flags()
    if len(units) > 1 and _ended(units[-2]):
        flags |= AFTER_SENTENCE
        if "\n" not in body[-len(units[-1]) - 2 : -len(units[-1])]:
            flags |= SAME_LINE
    if _signed(body):
        flags |= SIGNED
    return units, flags, body


def _signed(body: str) -> bool:
    """Whether the text ends with a signature and at most three short lines after it."""
    for line in reversed(body.rsplit("\n", 4)[-4:]):
        if _SIGNED.match(line):
            return True
        if len(line) > 120:
            return False
    return False


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _SCHEMA.split(", ")])
    counts: dict[str, list[int]] = {}

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        if counts:
            yield emit([("s", None, None, k, None, None, n, e, None, None) for k, (n, e) in counts.items()])
            counts.clear()

    for batch in batches:
        rows = []
        for doc, text, source in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source"))):
            if text is None or not text.strip():
                rows.append(("d", doc, source, None, None, None, None, None, 0, 0))
                continue
            units, flags, _ = read_text(text)
            last = units.pop()
            for unit in units:
                end = 1 if _ended(unit) else 0
                for key in _keys(unit):
                    c = counts.get(key)
                    if c is None:
                        counts[key] = [1, end]
                    else:
                        c[0] += 1
                        c[1] += end
            keys, words = _keys(last), len(last.split())
            if _ended(last):
                # a whole end counts for its opening like any other sentence
                for key in keys:
                    c = counts.setdefault(key, [0, 0])
                    c[0] += 1
                    c[1] += 0 if flags & (MARKED | BROKEN) else 1
            keys = (keys + [None] * 3)[:3]
            rows.append(("d", doc, source, *keys, None, None, words, flags))
            if _ended(last):
                continue
            for key in keys:
                if key is not None:
                    c = counts.setdefault(key, [0, 0])
                    c[0] += 1
        if rows:
            yield emit(rows)
        if len(counts) > 200_000:
            yield from flush()
    yield from flush()


def find_truncated(documents: DataFrame, min_share: float = 0.8, min_count: int = 3) -> DataFrame:
    """(doc_id, source, cut, share, flags) for every row of `documents` (doc_id, text, source).

    `cut` says that the text stops within a sentence. share is the part of the sentences with the same opening
    that end with a terminator, by the longest opening (of up to three words) seen `min_count` times.
    Null, empty and blank texts are not cut; repeated rows give repeated rows; other columns are left out.
    """
    scanned = cut_lineage(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).mapInArrow(_scan, _SCHEMA))
    stats = scanned.where("kind = 's'").groupBy(F.col("key1").alias("key")).agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    ends = scanned.where("kind = 'd'").select("doc_id", "source", "key1", "key2", "key3", "words", "flags")
    asked = ends.where(F.col("flags") != 0).select(F.explode(F.array("key1", "key2", "key3")).alias("key")).where(F.col("key").isNotNull()).distinct()
    stats = stats.where(F.col("n") >= min_count).join(asked, "key", "left_semi").select("key", F.struct((F.col("ended") / F.col("n")).alias("share"), "n").alias("stat"))
    out = ends
    for k in (1, 2, 3):
        # short ends lack a key: each gets its own, so that they do not meet in one partition
        out = out.withColumn(f"key{k}", F.coalesce(f"key{k}", F.concat(F.lit("\x01"), F.xxhash64("doc_id", "source", "key1").cast("string"))))
        out = out.join(stats.select(F.col("key").alias(f"key{k}"), F.col("stat").alias(f"stat{k}")), f"key{k}", "left")
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    # the k-th word of an opening is looked up only if another word follows it, or it is seen on its own
    share = F.coalesce(*[F.when(F.col("words") >= k, F.col(f"stat{k}.share")) for k in (3, 2, 1)])
    marked = has(MARKED) | has(BROKEN)
    out = out.withColumn("share", share)
    certain = (F.col("words") > 0) & (has(BROKEN) | has(UNENDED) & (F.col("share") >= 0.97))
    rates = out.groupBy("source").agg((F.sum(certain.cast("int")) / F.count(F.lit(1))).alias("rate"))
    out = out.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    bar = F.lit(min_share) - F.least(F.lit(0.2), F.col("rate"))
    # what follows a sentence in its line is prose unless its opening hardly ever ends as a sentence
    bar = F.when(has(SAME_LINE), 0.15).when(has(AFTER_SENTENCE), bar).otherwise(0.95)
    cut = F.when((F.col("words") == 0) | has(SIGNED) & ~marked, False).when(has(BROKEN), True).when(marked, F.coalesce(F.col("share"), F.lit(1.0)) >= 0.3).when(
        has(UNENDED), F.when(F.col("share").isNotNull(), F.col("share") >= F.when(has(OPEN_BRACKET), F.least(F.lit(0.5), bar)).otherwise(bar)).otherwise(has(AFTER_SENTENCE) | has(OPEN_BRACKET)))
    return out.select("doc_id", "source", F.coalesce(cut, F.lit(False)).alias("cut"), "share", "flags")


def truncation_by_source(found: DataFrame) -> DataFrame:
    """(source, documents, cut_documents, cut_share) from find_truncated's rows; a null source is a source of its own."""
    cut = F.sum(F.col("cut").cast("int"))
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), cut.alias("cut_documents"), (cut / F.count(F.lit(1))).alias("cut_share"))
