"""Spellings of names that mean the same body or post.

Words first: an index of symmetric deletes over the folded words of all names finds words a small edit apart, and a
rare word is taken for the far more frequent one beside it. Names then: each becomes the list of its corrected words, and
lists that share a rare word or their initials are aligned, word to word by optimal assignment. A word may stand for another by
being equal, its initial, or an abbreviation, and several words may be one acronym. What may be left over is a state, or
a word of scope such as "National". Aligned lists are joined to the most frequent one of their block, and joined lists to classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.llm.arrow import with_column
from patrika.llm.components import connected_components
from patrika.session import cut_lineage, spread

# Words that carry no name.
STOP = {"the", "of", "for", "to", "post", "posts", "office", "in", "and", "an"}
# Words of scope that may be left out.
SCOPE = {"national", "central", "federal", "apex", "union", "state"}
# Phrases of one meaning, the first for the second; applied to corrected words.
SYNONYMS = [
    (("municipal", "corporation"), ("nagar", "nigam")), (("municipal", "council"), ("nagar", "palika")), (("municipal", "council"), ("nagar", "parishad")),
    (("port", "authority"), ("port", "trust")), (("town", "panchayat"), ("nagar", "panchayat")), (("district", "court"), ("court", "district", "judge")),
    (("district", "court"), ("district", "judge", "court")), (("recruitment",), ("bharti",)), (("zilla",), ("jila",)), (("zilla", "parishad"), ("district", "council")),
    (("agricultural", "university"), ("krishi", "vidyapeeth")), (("draughtsman",), ("draftsman",)), (("university",), ("vishwavidyalaya",)), (("stenographer",), ("steno",)),
]

# Short forms that could stand for several words, and the one they are used for.
USUAL = {"elec": "electrical"}

#: Longer words are no words that people type; they are kept as they are, and no deletes of them are made.
LONGEST = 40

_TOKEN = re.compile(r"(?:[^\W_]\. ?){2,}(?:[^\W_]\b)?|[^\W_]+(?:[/'’][^\W_]+)*")
_PLAIN, _JOINS = re.compile(r"[^\W_]+"), re.compile(r"[./'’]")
_DOTTED = re.compile(r"(?:[^\W_]\. ?){2,}[^\W_]?")
_MARKS = str.maketrans("", "", "./'’ ")
_SYNONYM_STARTS = {phrase[0] for _, phrase in SYNONYMS}
_FOLDS = [("aa", "a"), ("ee", "i"), ("oo", "u"), ("w", "v"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("kh", "k"), ("ph", "f"), ("jh", "j"), ("chh", "ch"), ("sh", "s"), ("z", "j")]


def fold(word: str) -> str:
    """A word without what transliteration leaves open: long vowels, aspirates, doubled letters."""
    for a, b in _FOLDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


def words_of(name: str) -> list[str]:
    """Lower-case words in order; dotted, slashed and apostrophised short forms are one word, acronyms begin with "="."""
    out = []
    mixed = any(c.islower() for c in name)
    # most names hold none of the marks that join a token
    plain = not _JOINS.search(name)
    tokens = (_PLAIN if plain else _TOKEN).findall(name)
    for token in tokens:
        word = token.lower() if plain else token.translate(_MARKS).lower()
        short = 2 <= len(word) <= 6 and word.isalpha()
        if short and ("." in token and _DOTTED.fullmatch(token) or token.isupper() and "/" not in token and (mixed or len(tokens) == 1)):
            out.append("=" + word)
        elif word and word not in STOP:
            out.append(USUAL.get(word, word))
    return out


def deletes(word: str, most: int) -> set[str]:
    """The word and what is left of it without one letter, or without two if `most` is 2."""
    out = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out |= layer
    return out


def edits(a: str, b: str) -> int:
    """Edits that turn a into b, a swap of neighbours being one; 3 means three or more."""
    if abs(len(a) - len(b)) > 2 or len(set(a) ^ set(b)) > 4:
        return 3
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > 2:
            return 3
        before, last = last, row
    return min(3, last[-1])


def abbreviates(short: str, word: str) -> bool:
    """Whether `short` is an initial, a beginning, or letters of `word` in their order from the first on."""
    if short[0] == "=" or word[0] == "=":
        return False
    s, word = re.sub(r"(.)\1+", r"\1", short), re.sub(r"(.)\1+", r"\1", word)
    if not s or s[0] != word[0] or len(s) >= len(word):
        return False
    if len(s) == 1 or word.startswith(s):
        return True
    at = 0
    for c in s:
        at = word.find(c, at) + 1
        if not at:
            return False
    # more than half of a long word in order is a misspelling rather than an abbreviation
    return len(s) <= 0.75 * len(word)


def acronym_of(token: str, words: list[str]) -> int:
    """How many of `words`, from the first on, `token` is made of by beginnings of each in turn; 0 if not two or more."""
    token = token.lstrip("=")
    if not words or token[:1] != words[0][:1]:
        return 0
    if len(words) > 1 and token == words[0] + words[1]:
        return 2
    if len(token) > 8 or len(words) < 2 or any(w[0] == "=" for w in words[:2]):
        return 0
    ends = {(0, 0)}
    best = 0
    for k, word in enumerate(words[: len(token)]):
        nxt = set()
        for at, _ in ends:
            n = 0
            while at + n < len(token) and n < len(word) and token[at + n] == word[n] and n < 5:
                n += 1
                nxt.add((at + n, k + 1))
        ends = nxt
        if any(at == len(token) for at, _ in ends):
            best = k + 1
    return best if best > 1 else 0


@lru_cache(maxsize=1 << 18)
def _same(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if abbreviates(a, b) or abbreviates(b, a):
        return 0.8
    if a[0] == "=" or b[0] == "=":
        return 0.0
    if min(len(a), len(b)) >= 4 and a[0] == b[0] and edits(a, b) <= 1:
        return 0.6
    if min(len(a), len(b)) >= 6 and edits(a, b) <= (1 if min(len(a), len(b)) < 9 or a[0] != b[0] else 2):
        return 0.6
    return 0.0


def _matched(values: list[list[float]]) -> list[int] | None:
    """The column of each row in the assignment of greatest sum, by augmenting paths; null if a row needs a value of 0. Columns are no fewer than rows."""
    n, m, never = len(values), len(values[0]) if values else 0, 1e6
    cost = [[-v if v > 0 else never for v in row] for row in values]
    of_row, of_column, taken = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        taken[0], j = i, 0
        least, back, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while taken[j]:
            used[j] = True
            row, nearest, step = taken[j], 0, float("inf")
            for k in range(1, m + 1):
                if not used[k]:
                    d = cost[row - 1][k - 1] - of_row[row] - of_column[k]
                    if d < least[k]:
                        least[k], back[k] = d, j
                    if least[k] < step:
                        step, nearest = least[k], k
            for k in range(m + 1):
                if used[k]:
                    of_row[taken[k]] += step
                    of_column[k] -= step
                else:
                    least[k] -= step
            j = nearest
        while j:
            taken[j] = taken[back[j]]
            j = back[j]
    places = {taken[k] - 1: k - 1 for k in range(1, m + 1) if taken[k]}
    chosen = [places[i] for i in range(n)]
    return chosen if all(values[i][j] > 0 for i, j in enumerate(chosen)) else None


def _assign(left: list[str], right: list[str]) -> tuple[float, list[str]] | None:
    """(weight, words of `right` left over) of the best assignment of every word of `left`."""
    if not left:
        return 0.0, right
    if len(left) > len(right):
        return None
    values = []
    for word in left:
        row = [_same(word, w) for w in right]
        if max(row) <= 0:
            return None
        values.append(row)
    chosen = _matched(values)
    if chosen is None:
        return None
    return sum(values[i][j] for i, j in enumerate(chosen)), [w for j, w in enumerate(right) if j not in chosen]


def _finish(a: list[str], b: list[str], left: list[str], right: list[str], score: float, optional: set[str]) -> float:
    if len(left) > len(right):
        left, right = right, left
    if sum(w in SCOPE or w in optional for w in right) < len(right) - len(left):
        # whatever is assigned, a word that names is left over
        return 0.0
    got = _assign(left, right)
    if got is None:
        # what has no partner must be free to be left out on its own side
        held = [w for w in left if not (w in SCOPE or w in optional)]
        if len(held) == len(left) or not held and not score:
            return 0.0
        got = _assign(held, right)
        if got is None:
            return 0.0
    score, right = score + got[0], got[1]
    scopes = sum(w in SCOPE for w in right)
    if any(w not in SCOPE and w not in optional for w in right) or scopes > 1 or scopes and score < 2:
        return 0.0
    return score / max(len(a), len(b))


def align(a: list[str], b: list[str], optional: set[str]) -> float:
    """How well two word lists name the same: 0, or the weight of the best assignment, at most 1."""
    of_a, of_b = {w for w in a if w in SCOPE}, {w for w in b if w in SCOPE}
    if of_a and of_b and not of_a & of_b:
        return 0.0
    left, right = list(a), list(b)
    score = 0.0
    for word in a:
        if word in right:
            left.remove(word)
            right.remove(word)
            score += 1.0
    if got := _finish(a, b, left, right, score, optional):
        return got
    # acronyms, and words written as one, take several words of the other side at once
    taken = False
    for own, other in ((left, right), (right, left)):
        for token in list(own):
            if len(token) < 2 or token in SCOPE or token in other:
                continue
            for start in range(len(other) - 1):
                n = acronym_of(token, other[start:])
                if n and (token[0] != "=" or n == len(token) - 1):
                    del other[start : start + n]
                    own.remove(token)
                    score += 0.8 * n
                    taken = True
                    break
    return _finish(a, b, left, right, score, optional) if taken else 0.0


def one_meaning(words: list[str]) -> list[str]:
    """Words with each phrase of SYNONYMS replaced, once."""
    out = words
    if not _SYNONYM_STARTS.isdisjoint(words):
        out = list(words)
        for to, phrase in SYNONYMS:
            k = len(phrase)
            for i in range(len(out) - k + 1):
                if tuple(out[i : i + k]) == phrase:
                    out[i : i + k] = list(to)
                    break
    return out


def reduce_words(words: list[str], optional: set[str]) -> list[str]:
    """Corrected words without an acronym of the name itself, state names at the end, and with synonyms replaced."""
    out = list(words)
    for token in [*out[:1], *out[-1:]]:
        if token[0] == "=" and len(out) > 2:
            rest = [w for w in out if w != token]
            if acronym_of(token, rest) == len(rest) == len(token) - 1:
                out = rest
                break
    out = one_meaning(out)
    held = [w for w in out if w not in optional]
    return held if len(held) > 1 else out


def keys_of(words: list[str], rarity: list[int]) -> list[str]:
    """Blocks of a word list: its two rarest long words and its initials in order of the alphabet, with and without scope."""
    order = sorted((n, w) for w, n in zip(words, rarity) if len(w) >= 4 and w[0] != "=")
    # a second word only where it tells as much: a kind of body beside a place names too many
    out = [f"w:{w}" for n, w in order[:2] if n <= 20 * order[0][0] + 20]
    for held in (words, [w for w in words if w not in SCOPE]):
        if held:
            out.append("i:" + "".join(sorted("".join(w[1:] if w[0] == "=" else w[0] for w in held))))
    return out


def _joints(sig: str) -> list[dict[str, str]]:
    """Every word, and every two neighbours as one, with the initials of the other words."""
    words = sig.split(" ")
    initials = lambda rest: "".join(sorted(w[1:] if w[0] == "=" else w[0] for w in rest))
    out = [(w, initials(words[:i] + words[i + 1 :])) for i, w in enumerate(words) if len(w) >= 8]
    out += [(words[i] + words[i + 1], initials(words[:i] + words[i + 2 :])) for i in range(len(words) - 1)]
    return [{"joined": joined, "rest": rest} for joined, rest in out]


def _blocks(optional: set[str]):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each list of a block joined to the more frequent list that it aligns with best; rows come by block, the most frequent first.

        Only lists that align with none before them are kept, so a block needs no more memory than it has different names.
        """
        block, heads = None, []
        for batch in batches:
            out: list[tuple] = []
            for field, key, sig in zip(*(batch.column(c).to_pylist() for c in ("field_name", "key", "sig"))):
                if (field, key) != block:
                    block, heads = (field, key), []
                words = sig.split(" ")
                best, name = 0.0, None
                for head, other in heads:
                    weight = align(words, other, optional)
                    # of equal weights the more frequent name counts
                    if weight > best + 1e-9:
                        best, name = weight, head
                if name is None:
                    heads.append((sig, words))
                else:
                    out.append((field, sig, name))
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["field_name", "src", "dst"])

    return join


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each delete of each word that may be misspelt: (field_name, word, n, folded, key)."""
    names = ["field_name", "word", "n", "folded", "key"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for field, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if not 5 <= len(word) <= LONGEST or word[0] == "=":
                continue
            folded = fold(word)
            for key in deletes(folded, 2 if len(folded) >= 10 else 1):
                for column, value in zip(out, (field, word, n, folded, key)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=names)


def correct_words(names: DataFrame, ratio: float = 6.0) -> DataFrame:
    """(field_name, word, fixed) for every word of `names` (field_name, words, n) that is taken for another, by the symmetric-delete index.

    Words of fewer than five letters, of more than LONGEST, and acronyms are never taken for others.
    """
    words = names.select("field_name", F.explode("words").alias("word"), "n").groupBy("field_name", "word").agg(F.sum("n").alias("n"))
    index = cut_lineage(spread(words, "word").mapInArrow(_deleted, "field_name string, word string, n bigint, folded string, key string"))
    to = index.select("field_name", "key", F.col("word").alias("to"), F.col("folded").alias("to_folded"), F.col("n").alias("to_n"))
    # words seen once are no target but for words that fold alike
    oftener = (F.col("to_n") > F.col("n")) & (F.col("to_n") > 1)
    alike = (F.col("folded") == F.col("to_folded")) & ((F.col("to_n") > F.col("n")) | (F.col("to_n") == F.col("n")) & (F.col("to") < F.col("word")))
    pairs = index.join(to, ["field_name", "key"]).where((F.col("word") != F.col("to")) & (oftener | alike)).drop("key").distinct()
    # a fold alone is no edit; otherwise the other word must be far more frequent, the more so the further it is
    pairs = with_column(pairs, "d", "int", edits, "folded", "to_folded").where(
        (F.col("d") == 0)
        | (F.col("d") == 1) & ((F.col("to_n") >= F.when(F.length("word") > 5, ratio).otherwise(3 * ratio) * F.col("n")) | (F.length("word") >= 7) & (F.col("to_n") >= 2 * F.col("n")))
        | (F.col("d") == 2) & (F.length("folded") >= 8) & (F.col("to_n") >= 5 * ratio * F.col("n"))
    )
    rank = F.struct((-F.col("d")).alias("d"), (F.substring("word", 1, 1) == F.substring("to", 1, 1)).alias("first"), F.col("to_n").alias("n"), F.col("to").alias("to"))
    out = cut_lineage(pairs.groupBy("field_name", "word").agg(F.max(rank)["to"].alias("fixed")))
    # what a word is taken for may itself be taken for another: jumps double until no chain is left
    while True:
        step = out.select("field_name", F.col("word").alias("fixed"), F.col("fixed").alias("next"))
        moved = cut_lineage(out.join(step, ["field_name", "fixed"], "left").select("field_name", "word", F.coalesce("next", "fixed").alias("fixed"), F.col("next").isNotNull().alias("moved")))
        out = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return out


def replace_words(rows: DataFrame, fixes: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """`rows` (`key`, field_name, words and more) with each word that `fixes` (field_name, word, fixed) knows replaced by the words of `fixed`.

    `key` tells rows apart. Words that are more than `share` of all words, 1 / `share` of them at most, go by broadcast: no word that many rows hold is
    one partition of the join.
    """
    placed = rows.select(key, "field_name", F.explode("words").alias("word"))
    counts = cut_lineage(placed.groupBy("field_name", "word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") > share * total).select("field_name", "word")
    known = cut_lineage(fixes)
    held = placed.join(F.broadcast(often), ["field_name", "word"], "left_anti").join(known, ["field_name", "word"])
    hot = placed.join(F.broadcast(known.join(F.broadcast(often), ["field_name", "word"], "left_semi")), ["field_name", "word"])
    found = held.unionByName(hot).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("_fixes"))
    swapped = F.flatten(F.transform("words", lambda w: F.coalesce(F.split(F.col("_fixes")[w], " "), F.array(w))))
    return rows.join(found, key, "left").withColumn("words", F.when(F.col("_fixes").isNull(), F.col("words")).otherwise(swapped)).select(rows.columns)


def name_classes(spellings: DataFrame, states: list[str]) -> DataFrame:
    """(field_name, name, n, class_id, links): every different non-blank name with how often it occurs, the class of names it belongs to, and how many others are in it.

    `spellings` has field_name and name, one row an occurrence. `states` are names that may follow a name (a bounded list).
    Null and blank names are left out. A name without any word that names is a class of its own.
    """
    optional = {w for s in states for w in words_of(s)}
    names = spellings.select(F.col("field_name").cast("string").alias("field_name"), F.col("name").cast("string").alias("name")).where("trim(name) != ''").groupBy("field_name", "name").agg(F.count(F.lit(1)).alias("n"))
    names = cut_lineage(with_column(names, "words", "array<string>", words_of, "name").withColumn("id", F.monotonically_increasing_id()))
    corrected = replace_words(names.where(F.size("words") > 0), correct_words(names), "id")
    lists = with_column(corrected.withColumnRenamed("words", "given"), "words", "array<string>", lambda w: reduce_words(w, optional), "given").select("field_name", "name", "n", "words")
    lists = cut_lineage(lists.withColumn("sig", F.array_join(F.array_sort("words"), " ")))
    # one order of the words stands for all, the most frequent: acronyms need it
    sigs = lists.groupBy("field_name", "sig", "words").agg(F.sum("n").alias("n")).groupBy("field_name", F.col("sig").alias("sorted")).agg(F.sum("n").alias("n"), F.max(F.struct("n", F.array_join("words", " ").alias("sig")))["sig"].alias("sig"))
    sigs = cut_lineage(sigs)
    each = sigs.select("field_name", "sig", F.explode(F.split("sig", " ")).alias("word")).distinct()
    rarity = each.groupBy("field_name", "word").agg(F.count(F.lit(1)).alias("held"))
    with_rarity = each.join(rarity, ["field_name", "word"]).groupBy("field_name", "sig").agg(F.map_from_entries(F.collect_list(F.struct("word", "held"))).alias("held"))
    keys = lambda sig, held: list(dict.fromkeys(keys_of(sig.split(" "), [dict(held)[w] for w in sig.split(" ")])))
    keyed = with_column(sigs.join(with_rarity, ["field_name", "sig"]), "keys", "array<string>", keys, "sig", "held").withColumn("key", F.explode("keys"))
    # two words written as one elsewhere: both forms meet under the joined word and the initials of the others
    single = each.where(F.length("word") >= 6).select("field_name", F.col("word").alias("joined"))
    apart = with_column(sigs.select("field_name", "sig", "n"), "joints", "array<struct<joined:string,rest:string>>", _joints, "sig").withColumn("j", F.explode("joints")).select("field_name", "sig", "n", "j.joined", "j.rest")
    apart = apart.join(single.distinct(), ["field_name", "joined"], "left_semi")
    keyed = keyed.select("field_name", "key", "sig", "n").unionByName(apart.select("field_name", F.concat_ws("|", F.lit("j:"), "joined", "rest").alias("key"), "sig", "n"))
    blocks = spread(keyed, "field_name", "key").sortWithinPartitions("field_name", "key", F.desc("n"), "sig")
    edges = blocks.mapInArrow(_blocks(optional), "field_name string, src string, dst string").distinct()
    tag = lambda c: F.concat_ws("\x01", "field_name", c)
    classes = connected_components(edges.select(tag("src").alias("src"), tag("dst").alias("dst")))
    named = lists.join(sigs.select("field_name", F.col("sorted").alias("sig"), F.col("sig").alias("head")), ["field_name", "sig"]).withColumn("node", tag("head"))
    known = named.join(classes, "node", "left").select("field_name", "name", "n", F.coalesce("component", "node").alias("class_id"))
    bare = names.where(F.size("words") == 0).select("field_name", "name", "n", F.concat_ws("\x01", "field_name", F.lit("="), "name").alias("class_id"))
    return with_links(known.unionByName(bare))


def with_links(classes: DataFrame) -> DataFrame:
    """`classes` with the number of other rows of the same class."""
    sizes = classes.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("links"))
    return classes.join(sizes, "class_id").select(*classes.columns, "links")


def name_pairs(classes: DataFrame) -> DataFrame:
    """(field_name, name_a, name_b) of every two names of one class, the smaller by code point first."""
    a = classes.select("field_name", "class_id", F.col("name").alias("name_a"))
    b = classes.select("field_name", "class_id", F.col("name").alias("name_b"))
    return a.join(b, ["field_name", "class_id"]).where(F.col("name_a") < F.col("name_b")).select("field_name", "name_a", "name_b")
