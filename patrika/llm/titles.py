"""Titles that announce the same notice, equal or edited.

A title is read into what tells notices apart: year, stage, advertisement number, and the words that are left, which name the
body and the post. The words are brought to one spelling by the symmetric-delete index, short forms and acronyms to the words
they stand for in other titles. Titles with the same year, stage and number are then compared through fingerprints of their
words, 128 bits in which a rare word sets more bits than a common one. A vantage-point tree finds all fingerprints within a Hamming
radius: branches whose ring cannot meet the query's ball are pruned by the triangle inequality. Groups too large for one task are
cut into shards by vantage points drawn from a bounded sample. One shard holds a fingerprint; the shards before it that its ball
meets are asked for it, so that each pair within the radius is met once. The pairs found are checked by aligning their words.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.llm.arrow import with_column
from patrika.llm.components import connected_components
from patrika.llm.names import SCOPE, abbreviates, align, correct_words, edits, one_meaning, replace_words, with_links, words_of
from patrika.session import cut_lineage, spread

# Stages of a notice and the words that say so.
STAGES = {
    "recruitment": "recruitment", "rectt": "recruitment", "bharti": "recruitment", "vacancy": "recruitment", "result": "result", "results": "result", "admit": "admit_card",
    "hall": "admit_card", "answer": "answer_key", "corrigendum": "corrigendum", "interview": "interview", "syllabus": "syllabus", "addendum": "corrigendum",
}
# Words that stages, numbers and decorations are made of; they name neither body nor post.
PLAIN = {
    "the", "of", "for", "to", "post", "posts", "in", "and", "an", "a", "office", "card", "ticket", "key", "schedule", "vacancies", "vacancy", "advt", "advertisement", "notice", "notification", "no", "number",
    "pdf", "latest", "new", "apply", "online", "direct", "link", "official", "check", "details", "out", "download", "here", "now", "update", "released", "declared",
}

_YEAR = re.compile(r"\b(20\d\d)\b")
_NUMBER = re.compile(r"\b(?:advt|advertisement|notification|notice|no)[a-z]*\W{0,3}(?:no\W{0,3})?(\d+)\s*(?:/|-|of|\s)\s*((?:20)?\d\d)\b", re.I)
_COUNT = re.compile(r"\b\d[\d,]*\s+(?:posts?|vacanc[a-z]*)\b|\b(?:posts?|vacanc[a-z]*)\s*[:\-]\s*\d+", re.I)
_DECORATIONS = ("latest", "new", "pdf", "apply online", "direct link", "official notice", "check details", "notification out")
_DECORATION = re.compile(r"^\W*(?:latest|new|pdf|apply online|direct link|official notice|check details|notification out)\b[\s:|\-]+|[\s:|\-(]+(?:pdf|apply online|direct link|official notice|check details|notification out|new|latest)\W*$", re.I)


def read_title(title: str) -> tuple[str, str, str, list[str]]:
    """(year, stage or "", advertisement number or "", words in order)."""
    text = re.sub(r"\s+", " ", title).strip()
    number = ""
    digits = any(c.isdigit() for c in text)
    if digits and (m := _NUMBER.search(text)):
        number = f"{int(m.group(1))}"
        year = m.group(2)
        text = text[: m.start()] + " " + text[m.end() :]
        stated = year if len(year) == 4 else f"20{year}"
    else:
        stated = ""
    if digits:
        text = _COUNT.sub(" ", text)
    lower = text.lower()
    if any(word in lower for word in _DECORATIONS):
        for _ in range(2):
            text = _DECORATION.sub(" ", text)
    years = _YEAR.findall(text)
    year = years[-1] if years else stated
    text = _YEAR.sub(" ", text)
    words = [w for w in words_of(text) if not w.isdigit()]
    return year, "", number, words


def stage_of(words: list[str]) -> tuple[str, list[str]]:
    """(stage, the words that are left). A word a small edit from a stage's word says it too."""
    stage, out = "", []
    for k, word in enumerate(words):
        said = STAGES.get(word.lstrip("="))
        # "Police Recruitment Cell" names a body
        if said == "recruitment" and (k and words[k - 1] == "police" or k + 1 < len(words) and words[k + 1].startswith("cel")):
            out.append(said)
        elif said:
            stage = said if stage in ("", "recruitment") else stage
        elif word.lstrip("=") not in PLAIN:
            out.append(word)
    return stage, out


def mend(word: str) -> str:
    """A word a small edit from one of the fixed words, as that word."""
    if word in STAGES or word in PLAIN or len(word) < 5:
        return word
    letters = set(word)
    for known, own, most in _LONG.get(word[0], ()):
        # an edit changes two letters of the set at most
        if abs(len(known) - len(word)) <= most and len(own ^ letters) <= 2 * most and edits(word, known) <= most:
            return known
    return word


#: The long ones of the fixed words by their first letter, each with its letters and the edits that are forgiven.
_LONG: dict[str, list[tuple[str, set[str], int]]] = {}
for _word in sorted(w for w in {*STAGES, *PLAIN} if len(w) >= 6):
    _LONG.setdefault(_word[0], []).append((_word, set(_word), 1 if len(_word) < 8 else 2))


def fingerprint(words: list[str], common: set[str]) -> tuple[int, int]:
    """128 bits as two signed halves: one bit for a common word, three for another, none for words of scope."""
    bits = 0
    for word in set(words):
        if word in SCOPE:
            continue
        digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
        for k in range(1 if word in common else 3):
            bits |= 1 << (int.from_bytes(digest[2 * k : 2 * k + 2], "big") % 128)
    halves = [(bits >> 64) & (2**64 - 1), bits & (2**64 - 1)]
    return tuple(h - 2**64 if h >= 2**63 else h for h in halves)  # type: ignore[return-value]


class VantageTree:
    """A vantage-point tree over 128-bit fingerprints; leaves are compared in one go."""

    def __init__(self, points: np.ndarray, leaf: int = 512, seed: int = 1):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _distances(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.points[at] ^ to).sum(axis=1).astype(np.int32)

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        pick = int(self.rng.integers(len(at)))
        vantage = at[pick]
        rest = np.delete(at, pick)
        d = self._distances(rest, self.points[vantage])
        middle = int(np.median(d))
        near, far = rest[d <= middle], rest[d > middle]
        if not len(near) or not len(far):
            return at
        return (vantage, middle, self._build(near), self._build(far))

    def within(self, point: np.ndarray, radius: int) -> list[int]:
        """Indices of all fingerprints at most `radius` from `point`."""
        out: list[int] = []
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, np.ndarray):
                if len(node):
                    out.extend(node[self._distances(node, point) <= radius].tolist())
                continue
            vantage, middle, near, far = node
            d = int(np.bitwise_count(self.points[vantage] ^ point).sum())
            if d <= radius:
                out.append(int(vantage))
            if d - radius <= middle:
                stack.append(near)
            if d + radius > middle:
                stack.append(far)
        return out

    def near(self, points: np.ndarray, radius: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j) with points[i] within the radius of the tree's j: the whole set of queries goes down the tree at once and splits as it is pruned."""
        high, low = np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1])
        own_high, own_low = np.ascontiguousarray(self.points[:, 0]), np.ascontiguousarray(self.points[:, 1])
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, asked = stack.pop()
            if isinstance(node, np.ndarray):
                to_high, to_low = own_high[node], own_low[node]
                for k in range(0, len(asked), rows):
                    some = asked[k : k + rows]
                    d = np.bitwise_count(high[some][:, None] ^ to_high)
                    d += np.bitwise_count(low[some][:, None] ^ to_low)
                    at = np.flatnonzero(d <= radius)
                    yield some[at // len(node)], node[at % len(node)]
                continue
            vantage, middle, near, far = node
            d = np.bitwise_count(points[asked] ^ self.points[vantage]).sum(axis=1).astype(np.int32)
            hit = asked[d <= radius]
            yield hit, np.full(len(hit), vantage)
            for branch, chosen in ((near, asked[d - radius <= middle]), (far, asked[d + radius > middle])):
                if len(chosen):
                    stack.append((branch, chosen))

    def pairs(self, radius: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j) with i > j within the radius."""
        for i, j in self.near(self.points, radius, rows):
            yield i[i > j], j[i > j]


def plan_shards(sample: list[tuple[int, int]], depth: int, seed: int = 5) -> list[tuple[int, int, int]]:
    """Vantage points and medians of the upper levels of a tree, heap order: (high, low, middle), halves unsigned."""
    rng = random.Random(seed)
    points = [(h & (2**64 - 1)) << 64 | (low & (2**64 - 1)) for h, low in sample]
    levels: list[tuple[int, int, int]] = [(0, 0, 64)] * (2**depth - 1)

    def split(at: list[int], node: int) -> None:
        if node >= len(levels) or len(at) < 2:
            return
        vantage = rng.choice(at)
        d = [(p ^ vantage).bit_count() for p in at]
        middle = sorted(d)[len(d) // 2]
        levels[node] = (vantage >> 64, vantage & (2**64 - 1), middle)
        split([p for p, x in zip(at, d) if x <= middle], 2 * node + 1)
        split([p for p, x in zip(at, d) if x > middle], 2 * node + 2)

    if depth:
        split(points, 0)
    return levels


def shards_of(point: int, levels: list[tuple[int, int, int]], radius: int) -> list[int]:
    """Shards that a fingerprint belongs to, those within the radius of a border included."""
    out, stack = [], [0]
    while stack:
        node = stack.pop()
        if node >= len(levels):
            out.append(node)
            continue
        high, low, middle = levels[node]
        d = (point ^ (high << 64 | low)).bit_count()
        if d - radius <= middle:
            stack.append(2 * node + 1)
        if d + radius > middle:
            stack.append(2 * node + 2)
    return out


def home_and_asked(point: int, levels: list[tuple[int, int, int]], radius: int) -> tuple[int, list[int]]:
    """(the shard that holds a fingerprint, the shards before it that may hold others within the radius)."""
    home = 0
    while home < len(levels):
        high, low, middle = levels[home]
        home = 2 * home + (1 if (point ^ (high << 64 | low)).bit_count() <= middle else 2)
    return home, [s for s in shards_of(point, levels, radius) if s < home]


_LINK = ["field_name", "year", "stage", "number", "src", "dst"]


class _Words:
    """Numbers for words, and for each what rules out at a glance that another stands for it."""

    #: Lists of more words are not compared by numbers.
    MOST = 16

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.letters, self.length, self.first, self.scope = [], [], [], []
        self.arrays: tuple[np.ndarray, ...] = ()

    def __call__(self, sigs: list[str]) -> np.ndarray:
        """A row of numbers for each list of words, -1 after the last; a list that is too long begins with -2."""
        out = np.full((len(sigs), self.MOST), -1, dtype=np.int32)
        before = len(self.ids)
        for k, sig in enumerate(sigs):
            words = sig.split(" ")
            if len(words) > self.MOST:
                out[k, 0] = -2
                continue
            for i, word in enumerate(words):
                n = self.ids.get(word)
                if n is None:
                    n = self.ids[word] = len(self.ids)
                    mask = 0
                    for c in word:
                        mask |= 1 << (ord(c) % 64)
                    for column, value in zip((self.letters, self.length, self.first, self.scope), (mask, len(word), ord(word.lstrip("=")[:1] or "="), word in SCOPE)):
                        column.append(value)
                out[k, i] = n
        if len(self.ids) > before:
            self.arrays = np.array(self.letters, dtype=np.uint64), np.array(self.length), np.array(self.first), np.array(self.scope)
        return out

    def may_align(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where two lists surely do not align: a word that one of them holds alone is near none of the other's, and none may be an acronym."""
        out = np.ones(len(a), dtype=bool)
        shared = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
        of_a, of_b = (a >= 0) & ~shared.any(axis=2), (b >= 0) & ~shared.any(axis=1)
        width = np.maximum(of_a.sum(axis=1), of_b.sum(axis=1))
        known = (a[:, 0] >= 0) & (b[:, 0] >= 0)
        # most pairs differ in one word
        for low, high in ((1, 1), (2, self.MOST // 2)):
            at = np.flatnonzero((width >= low) & (width <= high) & known)
            if len(at):
                out[at] = self._may(*(np.take_along_axis(np.where(of, side, -1)[at], np.argsort(~of[at], axis=1, kind="stable")[:, :high], axis=1) for side, of in ((a, of_a), (b, of_b))))
        return out

    def _may(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        letters, length, first, scope = self.arrays
        there = (p >= 0)[:, :, None] & (q >= 0)[:, None, :]
        x, y = letters[p][:, :, None], letters[q][:, None, :]
        same_first = first[p][:, :, None] == first[q][:, None, :]
        # as `_same` does: an edit changes two letters of the set at most, a short form begins as its word and has no letter besides
        apart, further = np.bitwise_count(x ^ y), np.abs(length[p][:, :, None] - length[q][:, None, :])
        shorter = np.minimum(length[p][:, :, None], length[q][:, None, :])
        near = (shorter >= np.where(same_first, 4, 6)) & (apart <= 2) & (further <= 1) | same_first & (shorter >= 9) & (apart <= 4) & (further <= 2)
        near |= same_first & ((x & ~y == 0) | (y & ~x == 0))
        near &= there
        may = (near.any(axis=2) | (p < 0) | scope[p]).all(axis=1) & (near.any(axis=1) | (q < 0) | scope[q]).all(axis=1)
        # as `acronym_of` does: it begins as one of several words and has the first letter of another, or is two of them in full
        same_first &= there
        for token, words, begins, within, axis in ((p, q, same_first, y & ~x == 0, 2), (q, p, same_first, x & ~y == 0, 1)):
            held = letters[token]
            bits = np.uint64(1) << (first[words] % 64).astype(np.uint64)
            meets = there & ((held[:, :, None] & bits[:, None, :] if axis == 2 else held[:, None, :] & bits[:, :, None]) != 0)
            may |= (begins.any(axis=axis) & (meets.sum(axis=axis) > 1) & ((length[token] <= 8) | (begins & within).any(axis=axis))).any(axis=1)
        return may


def _links(radius: int, asked_rows: int = 4096, pair_rows: int = 20_000):
    # whether two lists align depends on the words they do not share, on how many they share (none, one, more) and on a shared word of scope
    known: dict[tuple, bool] = {}

    def aligns(a: str, b: str) -> bool:
        left, right = a.split(" "), b.split(" ")
        x, y = frozenset(left), frozenset(right)
        case = (x - y, y - x, min(len(x & y), 2), bool(x & y & SCOPE))
        same = known.get(case)
        if same is None:
            if len(known) > 1_000_000:
                known.clear()
            same = known[case] = align(left, right, set()) > 0
        return same

    def checked(found: Iterator[tuple[np.ndarray, np.ndarray]], words: _Words, left: tuple[list[str], np.ndarray], right: tuple[list[str], np.ndarray]) -> Iterator[tuple[str, str]]:
        for i, j in found:
            for k in range(0, len(i), pair_rows):
                a, b = i[k : k + pair_rows], j[k : k + pair_rows]
                may = words.may_align(left[1][a], right[1][b])
                for x, y in zip(a[may].tolist(), b[may].tolist()):
                    if aligns(left[0][x], right[0][y]):
                        yield left[0][x], right[0][y]

    def gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same pairs, `rows` of them or more at a time."""
        held, n = [], 0
        for pair in found:
            if len(pair[0]):
                held.append(pair)
                n += len(pair[0])
            if n >= rows:
                yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])
                held, n = [], 0
        if held:
            yield np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held])

    prints = lambda rows: np.array([r[1:] for r in rows], dtype=np.int64).view(np.uint64).reshape(-1, 2)

    def shard(rows: Iterator[tuple[bool, str, int, int]], words: _Words) -> Iterator[tuple[str, str]]:
        """Pairs of one shard: of those that it holds, which come first, and of each that asks with those."""
        held: list[tuple[str, int, int]] = []
        asking: list[tuple[str, int, int]] = []
        tree, own = None, ([], np.empty(0))

        def answer() -> Iterator[tuple[str, str]]:
            sigs = [r[0] for r in asking]
            yield from checked(gathered(tree.near(prints(asking), radius), pair_rows), words, (sigs, words(sigs)), own)
            asking.clear()

        def plant() -> Iterator[tuple[str, str]]:
            nonlocal tree, own
            tree, sigs = VantageTree(prints(held)), [r[0] for r in held]
            own = (sigs, words(sigs))
            yield from checked(gathered(tree.pairs(radius), pair_rows), words, own, own)

        for asks, *row in rows:
            if not asks:
                held.append(tuple(row))
                continue
            if tree is None:
                if not held:
                    return
                yield from plant()
            asking.append(tuple(row))
            if len(asking) >= asked_rows:
                yield from answer()
        if tree is None and len(held) > 1:
            yield from plant()
        if asking:
            yield from answer()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each shard whose fingerprints are within the radius and whose words align; rows come by shard."""
        columns = ("field_name", "year", "stage", "number", "shard", "asks", "sig", "high", "low")
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=_LINK)
        words = _Words()
        for key, own in groupby(rows, key=lambda row: row[:5]):
            if len(words.ids) > 200_000:
                words = _Words()
            for a, b in shard((row[5:] for row in own), words):
                out.append((*key[:4], a, b))
                if len(out) >= 10_000:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return link


def _plan(sample_rows: int):
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        """The upper levels of one group's own tree, from its sample."""
        key = group.iloc[0]
        levels = plan_shards(list(zip(group.high.tolist(), group.low.tolist()))[: 4 * sample_rows], int(key.depth))
        return pd.DataFrame([(key.field_name, key.year, key.stage, key.number, [x for level in levels for x in (_signed(level[0]), _signed(level[1]), level[2])])], columns=["field_name", "year", "stage", "number", "levels"])

    return plan


def _signed(half: int) -> int:
    return half - 2**64 if half >= 2**63 else half


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, str] = {}
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for title in batch.column(1).to_pylist():
            year, _, number, words = read_title(title)
            mended = []
            for w in words:
                m = memo.get(w)
                if m is None:
                    m = memo[w] = mend(w)
                mended.append(m)
            if len(memo) > 300_000:
                memo.clear()
            stage, rest = stage_of(mended)
            for column, value in zip(out, (year, stage, number, rest)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))))],
                                         names=["field_name", "title", "n", "year", "stage", "number", "words"])


#: Marks of acronyms, so that tasks leave out runs that are none: 65,536 at most, however many acronyms there are.
_ACRONYM_MARKS = 1 << 16


def _phrases(most: int, marks: set[int]):
    """Runs of two to `most` words whose initials may be an acronym, counted; no acronym has more letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        wanted: dict[str, bool] = {}

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_pydict({"initials": ["".join(w[0] for w in k) for k in keys], "phrase": [" ".join(k) for k in keys], "n": [seen[k] for k in keys]})
            seen.clear()
            return out

        for batch in batches:
            for words in batch.column(0).to_pylist():
                initials = "".join(w[0] for w in words)
                for i in range(len(words) - 1):
                    for size in range(2, min(most, len(words) - i) + 1):
                        name = initials[i : i + size]
                        wants = wanted.get(name)
                        if wants is None:
                            wants = wanted[name] = zlib.crc32(name.encode()) % _ACRONYM_MARKS in marks
                        if wants:
                            run = tuple(words[i : i + size])
                            if not any(len(w) < 3 or w[0] == "=" for w in run):
                                seen[run] += 1
            if len(wanted) > 400_000:
                wanted.clear()
            if len(seen) > 400_000:
                yield flush()
        if seen:
            yield flush()

    return count


def _expanded(full: list[tuple[str, int]]):
    """Each short word with the word it is a short form of: (word, fixed)."""
    by_letter: dict[str, list[tuple[str, int]]] = {}
    for word, n in full:
        by_letter.setdefault(word[0], []).append((word, n))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = [[], []]
            for short in batch.column(0).to_pylist():
                fits = [(word.startswith(short), n, word) for word, n in by_letter.get(short[0], ()) if len(word) > len(short) and abbreviates(short, word)]
                if fits:
                    out[0].append(short)
                    out[1].append(max(fits)[2])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["word", "fixed"])

    return expand


def short_forms(words: DataFrame, often: int) -> DataFrame:
    """(word, fixed) for words that are short forms of a word found in `often` titles or more, or acronyms of a run of words."""
    counts = cut_lineage(words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    capitals = counts.where(F.col("word").startswith("=")).select(F.expr("substring(word, 2)").alias("initials"), F.col("n").alias("capital_n"))
    # in a title all in capitals any short word looks like an acronym, in one without them none does
    capitals = capitals.join(counts.select(F.col("word").alias("initials"), F.col("n").alias("plain_n")), "initials", "left").withColumn("plain_n", F.coalesce("plain_n", F.lit(0)))
    capitals = cut_lineage(capitals)
    acronyms = capitals.where("capital_n >= plain_n").select("initials")
    words_only = capitals.where("capital_n < plain_n").select(F.concat(F.lit("="), "initials").alias("word"), F.col("initials").alias("fixed"))
    marks = {r[0] for r in acronyms.select((F.crc32("initials") % _ACRONYM_MARKS).alias("mark")).distinct().collect()}
    # words_of makes acronyms of at most six letters
    phrases = words.select("words").mapInArrow(_phrases(6, marks), "initials string, phrase string, n bigint")
    best = phrases.join(acronyms, "initials", "left_semi").groupBy("initials", "phrase").agg(F.sum("n").alias("n")).groupBy("initials").agg(F.max(F.struct("n", "phrase"))["phrase"].alias("fixed"))
    expanded = cut_lineage(best.select(F.explode(F.array(F.concat(F.lit("="), "initials"), "initials")).alias("word"), "fixed").unionByName(words_only))
    # a word in a thousandth of the titles: there are at most a thousand times the words of a title of them
    full = [(r.word, r.n) for r in counts.where((F.col("n") >= often) & (F.length("word") >= 5) & ~F.col("word").startswith("=")).collect()]
    short = counts.where((F.length("word") >= 2) & (F.col("n") < often) & ~F.col("word").startswith("=")).select("word")
    short = short.join(expanded.select("word"), "word", "left_anti")
    return cut_lineage(expanded.unionByName(spread(short, "word").mapInArrow(_expanded(full), "word string, fixed string")))


def notice_classes(titles: DataFrame, radius: int = 6, shard_rows: int = 4000, sample_rows: int = 4000) -> DataFrame:
    """(field_name, title, class_id) of every different title of `titles` (field_name, title, one row an occurrence).

    Titles with equal class_id announce the same notice. Null and blank titles are left out. A title without words is a class of
    its own text. The shards' vantage points come from `sample_rows` fingerprints; every fingerprint is indexed.
    """
    once = titles.select(F.col("field_name").cast("string").alias("field_name"), F.col("title").cast("string").alias("title")).where("trim(title) != ''").groupBy("field_name", "title").agg(F.count(F.lit(1)).alias("n"))
    read = once.mapInArrow(_read, "field_name string, title string, n bigint, year string, stage string, number string, words array<string>")
    read = cut_lineage(read.withColumn("id", F.monotonically_increasing_id()))
    total = read.count()
    anywhere = lambda frame: frame.withColumn("field_name", F.lit(""))  # noqa: E731 - words mean the same in both fields
    fixed = _respelled(read, correct_words(anywhere(read)))
    spelled = _respelled(fixed, anywhere(short_forms(fixed, max(20, total // 1000))))
    held = spelled.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().where(F.col("count") >= max(2, total // 50))
    common = {r.word for r in held.collect()}  # at most 50 times the words of a title
    key = ["field_name", "year", "stage", "number"]
    # words of scope stay in the signature, the synonyms of names are one
    sigs = cut_lineage(with_column(spelled, "sig", "string", _signature, "words").select(*key, "title", "n", "sig"))
    distinct = sigs.groupBy(*key, "sig").agg(F.sum("n").alias("n"))
    print_of = lambda sig: dict(zip(("high", "low"), fingerprint(sig.split(" "), common)))
    printed = cut_lineage(with_column(distinct.where("sig != ''"), "f", "struct<high:bigint,low:bigint>", print_of, "sig").select(*key, "sig", "n", "f.high", "f.low"))
    # at most a 4000th of the titles
    sizes = cut_lineage(printed.groupBy(*key).count().where(F.col("count") > shard_rows).withColumn("depth", F.ceil(F.log2(F.col("count") / shard_rows)).cast("int") + 1))
    routed = printed.withColumn("shard", F.lit(-1)).withColumn("asks", F.lit(False))
    if not sizes.isEmpty():
        large = printed.join(F.broadcast(sizes), key)
        sample = large.where(F.pmod(F.xxhash64("high", "low"), F.lit(1_000_000)) < F.lit(1_000_000 * sample_rows) / F.col("count"))
        # a plan has twice as many nodes as its group has shards
        plans = cut_lineage(sample.groupBy(*key).applyInPandas(_plan(sample_rows), "field_name string, year string, stage string, number string, levels array<bigint>"))
        route = lambda high, low, levels: dict(zip(("home", "asked"), home_and_asked((high & (2**64 - 1)) << 64 | (low & (2**64 - 1)), [(levels[k] & (2**64 - 1), levels[k + 1] & (2**64 - 1), levels[k + 2]) for k in range(0, len(levels), 3)], radius)))
        planned = large.drop("count", "depth").join(F.broadcast(plans), key)
        cut = with_column(planned, "to", "struct<home:int,asked:array<int>>", route, "high", "low", "levels")
        cut = cut.withColumn("shard", F.explode(F.concat(F.array("to.home"), "to.asked"))).withColumn("asks", F.col("shard") != F.col("to.home"))
        routed = cut.select(routed.columns).unionByName(routed.join(F.broadcast(sizes.select(*key)), key, "left_anti").select(routed.columns))
    grouped = spread(routed, *key, "shard").sortWithinPartitions(*key, "shard", "asks", F.desc("n"), "sig")
    links = grouped.mapInArrow(_links(radius), "field_name string, year string, stage string, number string, src string, dst string")
    tag = lambda c: F.concat_ws("\x01", *key, c)
    classes = connected_components(links.select(tag("src").alias("src"), tag("dst").alias("dst")))
    named = sigs.withColumn("node", F.when(F.col("sig") == "", F.concat_ws("\x01", "field_name", F.lit("="), "title")).otherwise(tag("sig")))
    return named.join(classes, "node", "left").select("field_name", "title", F.coalesce("component", "node").alias("class_id"))


def _respelled(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    swapped = replace_words(rows.withColumnRenamed("field_name", "_field").withColumn("field_name", F.lit("")), fixes, "id")
    return cut_lineage(swapped.drop("field_name").withColumnRenamed("_field", "field_name").select(rows.columns))


def _signature(words: list[str]) -> str:
    """The words sorted, phrases of one meaning brought to one."""
    return " ".join(sorted(set(one_meaning(words))))


def notice_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(field_name, id, class_id, links) of every id of `rows` (field_name, id, title) with a title: its class, and how many other ids are in it."""
    placed = rows.select("field_name", F.col("id").cast("string").alias("id"), "title").where("id is not null").join(classes, ["field_name", "title"])
    return with_links(placed.select("field_name", "id", "class_id").distinct())


def notice_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b) of every two ids of `rows` (field_name, id, title) whose titles are of one class."""
    placed = rows.select("field_name", F.col("id").cast("string").alias("id"), "title").where("id is not null").join(classes, ["field_name", "title"]).select("field_name", "class_id", "id").distinct()
    a, b = placed.withColumnRenamed("id", "id_a"), placed.withColumnRenamed("id", "id_b")
    return a.join(b, ["field_name", "class_id"]).where(F.col("id_a") < F.col("id_b")).select("field_name", "id_a", "id_b").distinct()
