"""Repair of text read from scanned pages.

Three kinds of noise are found line by line: page furniture (running heads, feet, page numbers), words split by the line
end, and misread characters. An averaged perceptron edits: for each word it chooses between keeping it, replacing characters by the
pairs of LETTER_SLIPS and DIGIT_SLIPS, one or two a word, and, in a word that the texts hardly know, deleting or inserting one; for
each hyphen at a line end, between joining the parts and keeping the hyphen. It is trained on words of the corpus that are spoilt
and split at random, and sees how often a word, its correction, its parts and the whole occur in all texts.

Furniture is told by fixed rules: where a line stands on its page, its form, and whether it comes again (furniture_lines).
Only replaced characters count as misread; lost and added ones are repaired.

Word counts cover all texts; the lexicon kept from them is bounded by `lexicon_words`, the training sample by
`sample_words`. Both are parameters of the model. The most frequent tokens are decided once for all tasks, the others where
they are met; decisions are kept per distinct token, so a text costs one look-up a token.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.session import cut_lineage, spread

# What a scanner reads, and what was printed.
LETTER_SLIPS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("@", "a"), ("5", "s"), ("$", "s"), ("8", "b"), ("9", "g"), ("6", "b"),
    ("c", "e"), ("f", "t"), ("b", "h"), ("l", "i"), ("i", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("cl", "d"), ("rn", "m"), ("m", "rn"),
    ("ii", "u"), ("vv", "w"), ("li", "h"), ("d", "cl"), ("u", "ii"),
]
DIGIT_SLIPS = [("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "8"), ("g", "9"), ("z", "2"), ("|", "1"), ("!", "1")]

HYPHENS = "-‐¬­"
_EDGE = ".,;:()[]{}\"'“”‘’?…।*"
_SPLIT_END = re.compile(rf"(\S*\w)([{HYPHENS}])\s*$")
_DIGIT = "0-9oOlISBsgq"
_FOOT = re.compile(
    rf"^\s*(?:-\s*[{_DIGIT}]{{1,4}}\s*-|\[\s*[{_DIGIT}]{{1,4}}\s*\]|[{_DIGIT}]{{1,4}}|(?:p[a@][g9][ec])\s+[{_DIGIT}]{{1,4}}(?:\s*(?:[o0][ft]|/)\s*[{_DIGIT}]{{1,4}})?"
    rf"|p\s*\.?\s*[tf]\s*\.?\s*[o0]\s*\.?|[ceo][o0]n[tf](?:[di]|cl|inu[ec]d)\s*\.*\s*[{_DIGIT}]{{0,4}})\s*$", re.I)  # fmt: skip
_HEAD_NUMBER = re.compile(rf"^\s*[{_DIGIT}]{{1,4}}\s*\|\s*\S|\S\s{{4,}}[{_DIGIT}]{{1,4}}\s*$")
_FILE_NUMBER = re.compile(r"^\s*[fp]\.?\s*n[o0]\.?\s*\S+\s*$", re.I)
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)|\d+(?:am|pm|a\.m|p\.m|hrs|km|kg|m|cm|x)", re.I)
_TABLE = re.compile(r"\S {2,}\S")


def word_key(token: str) -> str:
    return token.strip(_EDGE).lower()


# ---------------------------------------------------------------- the editor


def proposals(word: str) -> list[tuple[int, int, str]]:
    """Edits (start, length, replacement) that undo a slip of the scanner somewhere in a lower-case word."""
    out = []
    digits = any(c.isdigit() for c in word)
    for slips, letters in ((LETTER_SLIPS, True), (DIGIT_SLIPS, False)):
        if not letters and not digits:
            continue
        for wrong, right in slips:
            at = word.find(wrong)
            while at >= 0:
                # a digit stands for a letter only beside one, a letter for a digit likewise
                left, after = word[at - 1 : at] if at else "", word[at + len(wrong) : at + len(wrong) + 1]
                if letters:
                    fits = not wrong[0].isdigit() or (left.isalpha() or after.isalpha()) and not (left.isdigit() or after.isdigit())
                else:
                    fits = left.isdigit() or after.isdigit() or after in tuple(",.:/") and word[at + 2 : at + 3].isdigit()
                if fits:
                    out.append((at, len(wrong), right))
                at = word.find(wrong, at + 1)
    return out


def apply(word: str, edits: tuple[tuple[int, int, str], ...]) -> str:
    for start, length, right in sorted(edits, reverse=True):
        word = word[:start] + right + word[start + length :]
    return word


def _bucket(n: int) -> str:
    return "0" if n <= 0 else str(min(9, n.bit_length()))


def _kind(c: str) -> str:
    return "^" if c == "" else "9" if c.isdigit() else "a" if c.isalpha() else c


class Editor:
    """The perceptron and the counts it looks at."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        self.weights: dict[str, float] = {}
        self.gap_weights: dict[str, float] = {}
        self.join_weights: dict[str, float] = {}

    def count(self, word: str) -> int:
        n = self.counts.get(word, 0)
        if not n and "-" in word:
            n = min((self.counts.get(p, 0) for p in word.split("-") if p), default=0)
        return n

    def features(self, word: str, edits: tuple, raw: str, hide: str | None = None, seen: int | None = None) -> list[str]:
        own = seen if seen is not None else 0 if word == hide else self.count(word)
        if not edits:
            return [f"keep:{_bucket(own)}", f"len:{min(len(word), 8)}:{own > 0}"]
        fixed = apply(word, edits)
        there = 0 if fixed == hide else self.count(fixed)
        ratio = "new" if not there else "inf" if not own else str(min(8, max(-3, (there // own).bit_length())))
        out = [f"edits:{len(edits)}", f"ratio:{ratio}", f"there:{_bucket(there)}:{min(len(word), 6)}", f"own:{_bucket(own)}:{ratio}"]
        for start, length, right in edits:
            wrong = word[start : start + length]
            left, after = word[start - 1 : start] if start else "", word[start + length : start + length + 1]
            slip = f"{wrong}>{right}"
            out += [f"slip:{slip}", f"slip:{slip}:{_kind(left)}{_kind(after)}", f"slip:{slip}:{ratio}", f"kinds:{_kind(wrong[:1])}{_kind(right[:1])}:{_kind(left)}{_kind(after)}", f"kinds:{_kind(wrong[:1])}{_kind(right[:1])}:{there > 0}"]
            shown = raw[start : start + 1] if len(raw) == len(word) else ""
            if shown and shown.islower() and raw.upper() != raw and sum(c.isupper() for c in raw) > len(raw) // 2:
                out.append("low in capitals")
        return out

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    def lost_or_added(self, word: str, own: int) -> list[tuple[int, int, str]]:
        """Single letters to delete or insert that make a far more frequent word of one that is hardly known."""
        if own > 2 or not 5 <= len(word) <= 40 or not (word.isascii() and word.isalpha()):
            return []
        least, counts = 20 * max(1, own), self.counts
        out = [(i, 1, "") for i in range(len(word)) if counts.get(word[:i] + word[i + 1 :], 0) >= least]
        return out + [(i, 0, c) for i in range(len(word) + 1) for c in "abcdefghijklmnopqrstuvwxyz" if counts.get(word[:i] + c + word[i:], 0) >= least]

    def candidates(self, word: str) -> list[tuple]:
        singles = proposals(word)
        out: list[tuple] = [(), *((e,) for e in singles)]
        # two slips in one word: where it has many places for them, only pairs that make a word of the texts
        few = len(singles) <= 14
        for i, a in enumerate(singles):
            out += [(a, b) for b in singles[i + 1 :] if (a[0] + a[1] <= b[0] or b[0] + b[1] <= a[0]) and (few or self.counts.get(apply(word, (a, b)), 0) > 0)]
        return out

    def best(self, word: str, raw: str, hide: str | None = None, seen: int | None = None) -> tuple:
        top, best = (), None
        for edits in self.candidates(word):
            s = self.score(self.features(word, edits, raw, hide, seen))
            if best is None or s > best + 1e-9:
                top, best = edits, s
        return top

    def fit(self, words: list[str], rounds: int = 3, seed: int = 7) -> None:
        """Train on `words`, kept as they are and spoilt at random."""
        rng = random.Random(seed)
        total: dict[str, float] = defaultdict(float)
        step = 1
        weights: dict[str, float] = defaultdict(float)
        self.weights = weights
        spoil: dict[str, list[str]] = defaultdict(list)
        for wrong, right in LETTER_SLIPS:
            spoil[right].append(wrong)
        numbers: dict[str, list[str]] = defaultdict(list)
        for wrong, right in DIGIT_SLIPS[:5]:
            numbers[right].append(wrong)

        def spoilt(word: str, table: dict[str, list[str]]) -> tuple[str, tuple] | None:
            places = [(i, r) for r in table for i in range(len(word)) if word.startswith(r, i)]
            if not places:
                return None
            i, right = rng.choice(places)
            wrong = rng.choice(table[right])
            return word[:i] + wrong + word[i + len(right) :], ((i, len(wrong), right),)

        for _ in range(rounds):
            rng.shuffle(words)
            for word in words:
                hide = word if rng.random() < 0.1 else None
                cases: list[tuple] = [(word, (), None)]
                for _ in range(2):
                    if (x := spoilt(word, spoil)) and apply(*x) == word:
                        # a slip that many texts share is itself seen, but far less than the word
                        share = 0 if hide else rng.choice((0, 0, 0.0005, 0.002, 0.006))
                        cases.append((*x, max(self.counts.get(x[0], 0), int(self.counts.get(word, 0) * share))))
                if rng.random() < 0.3:
                    number = rng.choice(["{}", "{}.{}.20{}", "{}/{}", "rs.{}", "{},{}00", "{}:{}", "a-{}/{}", "20{}"]).format(*(rng.randrange(10, 99) for _ in range(3)))
                    cases.append((number, (), 0))
                    if x := spoilt(number, numbers):
                        cases.append((*x, 0))
                for shown, gold, seen in cases:
                    got = self.best(shown, shown, hide, seen)
                    step += 1
                    if got != gold and apply(shown, got) != apply(shown, gold):
                        for f in self.features(shown, gold, shown, hide, seen):
                            weights[f] += 1
                            total[f] += step
                        for f in self.features(shown, got, shown, hide, seen):
                            weights[f] -= 1
                            total[f] -= step
        self.weights = {f: w - total[f] / step for f, w in weights.items() if w - total[f] / step}

    # letters lost or added

    def gap_features(self, word: str, own: int, edit: tuple[int, int, str]) -> list[str]:
        start, length, right = edit
        kind, letter = ("insert", right) if right else ("delete", word[start])
        there = self.counts.get(apply(word, (edit,)), 0)
        beside = letter in (word[start - 1 : start], word[start + length : start + length + 1])
        return ["bias", f"{kind}:{beside}", f"{kind}:{min(len(word), 10)}", f"own:{own}:{(there // max(1, own)).bit_length()}", f"place:{kind}:{'first' if not start else 'last' if start + length >= len(word) else 'inside'}"]

    def gap(self, word: str) -> tuple:
        """The edit of a lost or added letter in a word that is kept otherwise; empty if it is whole."""
        own = self.count(word)
        scored = [(sum(self.gap_weights.get(f, 0.0) for f in self.gap_features(word, own, e)), e) for e in self.lost_or_added(word, own)]
        best = max(scored, default=(0.0, None))
        return (best[1],) if best[0] > 0 else ()

    def fit_gaps(self, words: list[str], rounds: int = 4, seed: int = 13) -> None:
        """Train on `words` without one of their letters or with one doubled, and on the rarest words of the texts, which are whole."""
        rng = random.Random(seed)
        cases: list[tuple[list[str], int]] = []
        for word in words:
            if len(word) >= 6 and word.isascii() and word.isalpha():
                i = rng.randrange(len(word))
                for shown, gold in ((word[:i] + word[i + 1 :], (i, 0, word[i])), (word[:i] + word[i] + word[i:], (i, 1, ""))):
                    if shown not in self.counts:
                        own = rng.choice((0, 1))
                        cases += [(self.gap_features(shown, own, e), 1 if apply(shown, (e,)) == apply(shown, (gold,)) else -1) for e in self.lost_or_added(shown, own)]
        rare = sorted(w for w, n in self.counts.items() if n <= 2 and len(w) >= 5 and w.isascii() and w.isalpha())
        for word in rng.sample(rare, min(len(rare), len(words))):
            cases += [(self.gap_features(word, self.counts[word], e), -1) for e in self.lost_or_added(word, self.counts[word])]
        self.gap_weights = _averaged(cases, rounds, rng)

    # joining parts at a line end

    def _share(self, n: int) -> str:
        """How frequent a word is among all, so that a decision does not change as the corpus grows."""
        return "0" if n <= 0 else str(max(0, int(n * 1_000_000 / self.total)).bit_length())

    def join_features(self, joined: int, hyphened: int, left: int, right: int, sizes: tuple[int, int]) -> list[str]:
        """Counts of the whole word, of the word with its hyphen and of the parts on their own."""
        more = "none" if not joined and not hyphened else "joined" if joined >= hyphened else "hyphened"
        halves = self._share(min(left, right))
        return ["bias", f"more:{more}", f"halves:{halves}:{more}", f"parts:{left > 0}{right > 0}:{more}", f"left:{self._share(left)}:{more}", f"right:{self._share(right)}:{more}", f"sizes:{min(4, sizes[0])}:{min(4, sizes[1])}:{more == 'none'}"]

    def joins(self, features: list[str]) -> bool:
        return sum(self.join_weights.get(f, 0.0) for f in features) >= 0

    def fit_joins(self, words: list[str], rounds: int = 4, seed: int = 11) -> None:
        """Train on `words` split anywhere, which are to be joined, and on words of the texts with a hyphen of their own, which are not."""
        rng = random.Random(seed)
        own = sorted(w for w, n in self.counts.items() if n > 1 and w.count("-") == 1 and all(p.isalpha() for p in w.split("-")))
        cases: list[tuple[list[str], int]] = []
        for word in words:
            if len(word) >= 4:
                k = rng.randrange(2, len(word) - 1)
                # a third of the words are unknown to the texts as a whole
                joined = 0 if rng.random() < 0.33 else self.counts[word]
                cases.append((self.join_features(joined, 0, self.counts.get(word[:k], 0), self.counts.get(word[k:], 0), (k, len(word) - k)), 1))
        for word in rng.choices(own, k=len(cases)) if own else []:
            a, b = word.split("-")
            hyphened = 0 if rng.random() < 0.33 else self.counts[word]
            cases.append((self.join_features(self.counts.get(a + b, 0), hyphened, self.counts.get(a, 0), self.counts.get(b, 0), (len(a), len(b))), -1))
        self.join_weights = _averaged(cases, rounds, rng)


def _averaged(cases: list[tuple[list[str], int]], rounds: int, rng: random.Random) -> dict[str, float]:
    """Weights of an averaged perceptron over (features, 1 or -1)."""
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    for _ in range(rounds):
        rng.shuffle(cases)
        for features, gold in cases:
            step += 1
            if (1 if sum(weights[f] for f in features) >= 0 else -1) != gold:
                for f in features:
                    weights[f] += gold
                    total[f] += gold * step
    return {f: w - total[f] / step for f, w in weights.items()}


def train_editor(counts: dict[str, int], sample_words: int, min_count: int = 20) -> Editor:
    """An editor over `counts`, trained on `sample_words` words that are not slips of far more frequent ones: two thirds the most frequent, the rest drawn from all."""
    editor = Editor(counts)

    def sound(word: str) -> bool:
        return all(editor.count(apply(word, (e,))) < 30 * counts[word] for e in proposals(word)) and word.isalpha() and word.isascii()

    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n > 1 and len(w) > 1 and sound(w)]
    often = [w for w in words if counts[w] >= min_count][: sample_words * 2 // 3]
    seldom = words[len(often) :]
    chosen = often + random.Random(3).sample(seldom, min(len(seldom), sample_words - len(often)))
    editor.fit_joins(list(chosen))
    editor.fit_gaps(list(chosen))
    editor.fit(chosen)
    return editor


# ---------------------------------------------------------------- lines


def _plain(line: str) -> str:
    return re.sub(r"[^a-z]+", "", line.lower().replace("0", "o").replace("1", "l").replace("5", "s").replace("@", "a").replace("!", "i").replace("9", "g").replace("8", "b"))


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 3 or not a:
        return False
    return a == b or sum(x == y for x, y in zip(a, b)) >= 0.85 * max(len(a), len(b)) or sum(x == y for x, y in zip(a[::-1], b[::-1])) >= 0.85 * max(len(a), len(b))


def furniture_lines(lines: list[str]) -> set[int]:
    """Indices of the lines that belong to the page, not to the text."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if len(filled) < 2:
        return set()
    widths = sorted(len(lines[i].rstrip()) for i in filled)
    # a few wide lines, such as table rows, do not make the text one without pages
    if widths[-(-9 * len(widths) // 10) - 1] > 160:
        return set()
    width = max(w for w in widths if w <= 160)
    out: set[int] = set()
    for k, i in enumerate(filled):
        if _FOOT.match(lines[i]) and not (k and lines[i].strip().isdigit() and lines[filled[k - 1]].rstrip().endswith(":")):
            out.add(i)
    starts = [filled[0], *(filled[k + 1] for k, i in enumerate(filled[:-1]) if i in out)]
    heads: list[str] = []

    def head(i: int, first: bool) -> bool:
        line = lines[i].strip()
        if i in out or not line or line.endswith((".", ":", ";", ",", "।", "?")) and not _FILE_NUMBER.match(line) and not _HEAD_NUMBER.search(lines[i]):
            return False
        if _FILE_NUMBER.match(line) or _HEAD_NUMBER.search(lines[i]):
            return True
        if _TABLE.search(line) or _SPLIT_END.search(line[-120:]) or not any(c.isalpha() for c in line):
            return False
        later = [j for j in filled if j > i]
        if not later:
            return False
        after = lines[later[0]]
        words = [w for w in line.split() if w[:1].isalpha()]
        titled = sum(w[0].isupper() or w in ("of", "the", "for", "to", "and") for w in words) >= 0.7 * len(words) or line == line.lower()
        room = len(lines[i].rstrip()) + 1 + len(after.split()[0]) <= width
        starts_sentence = after.lstrip()[:1].isupper() or after.startswith("  ") or after.lstrip()[:1].isdigit()
        return bool(words) and titled and starts_sentence and (room or len(words) > 1 and line.isupper() or line[:1].islower() or first and len(line) >= 44 and abs(len(line) - 50) <= 2)

    for i in starts:
        if head(i, True):
            out.add(i)
            heads.append(_plain(lines[i]))
    if heads:
        for i in filled:
            if i not in out and any(_alike(_plain(lines[i]), h) for h in heads) and not lines[i].rstrip().endswith("."):
                out.add(i)
    # a title that stands between lines of running text and leaves room at its end was not put there by wrapping
    for k, i in enumerate(filled[1:-1], 1):
        line = lines[i].strip()
        if i in out or line.endswith((".", ":", ";", ",", "।", "?")) or _TABLE.search(line) or _SPLIT_END.search(line[-120:]):
            continue
        words = [w.lstrip("(") for w in line.split() if w.lstrip("(")[:1].isalpha()]
        upper = [w for w in words if w[0].isupper()]
        after = next((lines[j] for j in filled[k + 1 :] if j not in out), "")
        if len(upper) >= 2 and all(w[0].isupper() or w in ("of", "the", "for", "to", "and", "post", "key") for w in words) and after and len(lines[i].rstrip()) + 3 + len(after.split()[0]) <= width:
            out.add(i)
    for i in filled:
        if i not in out and _HEAD_NUMBER.search(lines[i]) and not re.search(r"\d\s{2,}\d", lines[i]) and len(lines[i]) <= width + 14 and re.search(r"[A-Za-z]{3}", lines[i]):
            out.add(i)
    # a number that answers a label is text, even with a page's head between them
    label = False
    for i in filled:
        if label and i in out and lines[i].strip().isdigit():
            out.discard(i)
        if i not in out:
            label = lines[i].rstrip().endswith(":")
    return out


class Reader:
    """Reads texts with an editor; decisions on words are kept."""

    def __init__(self, editor: Editor, decided: dict[str, tuple] | None = None, memo: int = 400_000):
        self.editor, self.limit, self.decided = editor, memo, decided or {}
        self.known = dict(self.decided)

    def edits(self, raw: str) -> tuple:
        """Edits of one bare token; positions are those of `raw`."""
        got = self.known.get(raw)
        if got is None:
            word = raw.lower()
            if len(word) != len(raw) or len(word) > 40 or _ORDINAL.fullmatch(word) or word.isdigit() or not any(c.isalnum() for c in word) or "http" in word or "www." in word:
                got = ()
            else:
                got = self.editor.best(word, raw) if proposals(word) else ()
                # a lost or added letter explains what no replacement makes a word of
                if not got or not self.editor.count(apply(word, got)):
                    got = self.editor.gap(word) or got
            if len(self.known) >= self.limit + len(self.decided):
                self.known = dict(self.decided)
            self.known[raw] = got
        return got

    def split_here(self, left: str, right: str, mark: str) -> bool:
        """Whether the hyphen between two parts came from the line end and not from the word."""
        if mark != "-":
            return True
        count = self.editor.counts
        hyphened = joined = 0
        halves = (0, 0)
        # a part that no text has on its own must not be corrected before it is read with the other
        for a in {left.lower(), apply(left.lower(), self.edits(left))}:
            for b in {right.lower(), apply(right.lower(), self.edits(right))}:
                last = a.rsplit("-", 1)[-1]
                hyphened = max(hyphened, count.get(f"{a}-{b}", 0), count.get(f"{last}-{b}", 0))
                joined = max(joined, count.get(last + b, 0))
                halves = max(halves, (count.get(a, 0), count.get(b, 0)), key=min)
        return self.editor.joins(self.editor.join_features(joined, hyphened, *halves, (len(left), len(right))))

    def read(self, text: str) -> tuple[list[tuple[int, str]], str]:
        """((line_no, defect) pairs, the repaired text)."""
        lines = text.split("\n")
        furniture = furniture_lines(lines)
        found = [(i + 1, "furniture") for i in sorted(furniture)]
        body = [i for i, line in enumerate(lines) if i not in furniture]
        misread: set[int] = set()
        hyphen: set[int] = set()
        paragraphs: list[str] = []
        current: list[str] = []
        carried: str | None = None
        strip = _EDGE
        for k, i in enumerate(body):
            line = lines[i]
            tokens = line.split()
            if not tokens:
                # a page end between lines of one paragraph leaves no blank line of its own
                if current and (k == 0 or not (body[k - 1] + 1 != i and current[-1][-1:].islower())):
                    paragraphs.append(" ".join(current))
                    current = []
                continue
            out: list[str] = []
            first = 0
            if carried is not None:
                tokens[0] = carried + tokens[0]
                first = len(carried)
                carried = None
            joins = None
            m = _SPLIT_END.search(line.rstrip()[-120:])
            if m and k + 1 < len(body):
                after = next((lines[j] for j in body[k + 1 : k + 4] if lines[j].strip()), "")
                head = after.split()[0].strip(strip) if after else ""
                left = tokens[-1].rstrip(HYPHENS).lstrip(strip)
                if head[:1].isalpha() and (head[0].islower() or left.isupper()) or head[:1] in "@!0159" and head[1:2].isalpha():
                    joins = self.split_here(left, head, m.group(2))
                    if joins:
                        hyphen.add(i)
            for n, token in enumerate(tokens):
                last = n == len(tokens) - 1
                if joins is not None and last:
                    # read with the part on the next line
                    carried = token.rstrip(HYPHENS) if joins else token
                    continue
                bare = token.strip(strip)
                if bare:
                    edits = self.known.get(bare)
                    if edits is None:
                        edits = self.edits(bare)
                    if edits:
                        at = token.index(bare)
                        fixed = bare
                        for start, length, right in sorted(edits, reverse=True):
                            if not length or not right:
                                pass
                            elif n == 0 and first and at + start < first:
                                misread.add(body[k - 1] if lines[body[k - 1]].strip() else i)
                            else:
                                misread.add(i)
                            shown = fixed[start : start + length]
                            others = fixed[:start] + fixed[start + length :]
                            upper = shown.isupper() or not shown.islower() and any(c.isalpha() for c in others) and others.isupper() or start == 0 and len(fixed) > 1 and not shown.islower() and fixed[1:].islower()
                            fixed = fixed[:start] + (right.upper() if upper else right) + fixed[start + length :]
                        token = token[:at] + fixed + token[at + len(bare) :]
                out.append(token)
            if out:
                current.append(" ".join(out))
        if carried is not None:
            current.append(carried)
        if current:
            paragraphs.append(" ".join(current))
        found += [(i + 1, "misread") for i in misread] + [(i + 1, "hyphen") for i in hyphen]
        return found, "\n\n".join(paragraphs)


# ---------------------------------------------------------------- Spark


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        bare: Counter = Counter()
        for token, n in seen.items():
            if (raw := token.strip(_EDGE)) and any(c.isalnum() for c in raw):
                # a part before a line end is no word, but it is read
                bare[raw, token[-1] not in HYPHENS] += n
        seen.clear()
        words = [raw.lower() if whole and any(c.isalpha() for c in raw) else None for raw, whole in bare]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([raw for raw, _ in bare], pa.string()), pa.array(list(bare.values()), pa.int64())], names=["word", "raw", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(text.split())
        if len(seen) > 500_000:
            yield flush()
    yield flush()


def fit_editor(texts: DataFrame, lexicon_words: int = 60_000, sample_words: int = 1_500, decided_tokens: int = 100_000) -> tuple[Editor, dict[str, tuple]]:
    """(editor, decisions): count the words of all `texts` (column text), keep the most frequent `lexicon_words`, train on `sample_words` of them.

    decisions holds the edits of the most frequent `decided_tokens` different tokens, made once in Arrow batches; it only saves
    deciding them again in every task.
    """
    spark = texts.sparkSession
    counted = cut_lineage(texts.select("text").mapInArrow(_count_words, "word string, raw string, n bigint").groupBy("word", "raw").agg(F.sum("n").alias("n")))
    top = counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(lexicon_words).collect()
    editor = train_editor({r.word: r.n for r in top}, sample_words)
    shared = spark.sparkContext.broadcast((editor.counts, editor.weights, editor.gap_weights, editor.join_weights))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(_editor(shared.value))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("right", pa.string())]))
        for batch in batches:
            raws = batch.column(0).to_pylist()
            edits = [[{"start": a, "length": b, "right": c} for a, b, c in reader.edits(raw)] for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(edits, kind)], names=["raw", "edits"])

    tokens = counted.groupBy("raw").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "raw").limit(decided_tokens).select("raw")
    rows = spread(tokens, "raw").mapInArrow(decide, "raw string, edits array<struct<start:int,length:int,right:string>>").collect()
    return editor, {r.raw: tuple((e.start, e.length, e.right) for e in r.edits) for r in rows}


def _editor(values: tuple) -> Editor:
    editor = Editor(values[0])
    editor.weights, editor.gap_weights, editor.join_weights = values[1:4]
    return editor


def repair_scans(texts: DataFrame, fitted: tuple[Editor, dict[str, tuple]]) -> DataFrame:
    """(field_name, record_id, defects, repaired) for every row of `texts` (field_name, record_id, text).

    defects is array<struct<line_no, defect>>, repaired the text without furniture, its words joined and corrected, one
    line a paragraph. Null texts give no defects and a null text, empty ones an empty text. Repeated rows are repaired alike.
    """
    editor, decided = fitted
    shared = texts.sparkSession.sparkContext.broadcast((editor.counts, editor.weights, editor.gap_weights, editor.join_weights, decided))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(_editor(shared.value), shared.value[4])
        kind = pa.list_(pa.struct([("line_no", pa.int32()), ("defect", pa.string())]))
        for batch in batches:
            defects, repaired = [], []
            for text in batch.column(2).to_pylist():
                found, fixed = reader.read(text) if text is not None else ([], None)
                defects.append([{"line_no": n, "defect": d} for n, d in found])
                repaired.append(fixed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(defects, kind), pa.array(repaired, pa.string())], names=["field_name", "record_id", "defects", "repaired"])

    rows = texts.select(F.col("field_name").cast("string").alias("field_name"), F.col("record_id").cast("string").alias("record_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "field_name string, record_id string, defects array<struct<line_no:int,defect:string>>, repaired string")
