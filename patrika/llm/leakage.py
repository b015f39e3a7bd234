"""Evaluation texts inside training documents, by a positional inverted index.

build_index stores the postings of training tokens: for each shard of documents and each term, every document and position at
which the term stands. The index is sharded by document, so no posting is shuffled and a term in every document is no hot key;
it is kept in the shared folder and answers any set of items over its terms without reading the documents again.

search_index goes through the shards. Each item asks for its rarest terms first: the smallest set of positions, taken by rising
document frequency, that puts a given number of them into every window of the least passage. Their lists, moved back by the
term's offset in the item, are intersected: a passage that keeps its share of the weight can lose few of these, as they
weigh most, so `needed` of them must meet within `slack` words. Where they meet, the passage is read from the lists of all the item's
words: the best run of matched words in their order that allows altered, missing and added words, weighted by rarity, so
that a question of like shape with other names and figures fails. A run without any of these is an exact phrase,
another a proximity match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.session import cut_lineage

WORD = re.compile(r"[^\W_]+")

#: A block of queries is sent to all executors; more items than this go in several blocks.
BLOCK_CHARS = 32 * 1024 * 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def anchor_positions(words: list[str], frequency: dict[str, int], window: int, per_window: int) -> list[int]:
    """Positions of the rarest words so that every `window` consecutive words hold `per_window` of them."""
    n = len(words)
    window = max(1, min(window, n))
    per_window = min(per_window, window)
    held = [0] * (n - window + 1)
    chosen = []
    for k in sorted(range(n), key=lambda k: (frequency.get(words[k], 0), k)):
        span = range(max(0, k - window + 1), min(k, n - window) + 1)
        if any(held[s] < per_window for s in span):
            chosen.append(k)
            for s in span:
                held[s] += 1
    return chosen


def anchor_plan(words: int, least: float, share: float) -> tuple[int, int, int]:
    """(window, anchors in every window, anchors that a passage must meet) for an item of so many words."""
    window = max(1, math.ceil(words * least))
    lost = math.floor((1 - share) * window)
    needed = min(window, lost + 2)
    return window, min(window, needed + lost), max(1, min(needed, window - lost))


def could_hold(item: list[str], held: set[str], weight: list[float], window: int, share: float) -> bool:
    """Whether any span of at least `window` words has `share` of its weight in words of the document, in whatever order."""
    total, sums, least = 0.0, [0.0], 0.0
    for i, word in enumerate(item):
        total += weight[i] * (1 - share) if word in held else -weight[i] * share
        sums.append(total)
        if i + 1 >= window:
            least = min(least, sums[i + 1 - window]) if i + 1 > window else 0.0
            if total >= least:
                return True
    return False


def locate_passage(item: list[str], doc: dict[int, str], offset: int, weight: list[float], slack: int, penalty: float = 2.0) -> tuple[int, float, int, bool]:
    """The best passage near `offset`: (words of the item that it spans, share of their weight that is matched, where it begins, whether it is an exact phrase).

    `doc` gives the word at a position; positions of words that the item does not have may be left out.
    """
    d, last = offset, len(item) - 1
    run, start, began, matched, total, exact = 0.0, 0, offset, 0.0, 0.0, True
    best = (0, 0.0, offset, False)
    top = 0.0
    for i, word in enumerate(item):
        hit = doc.get(i + d) == word
        if not hit and i < last:
            after = item[i + 1]
            for s in range(1, slack + 1):
                for q in (i + d + s, i + d - s):
                    if doc.get(q) == word and doc.get(q + 1) == after:
                        hit, d, exact = True, q - i, False
                        break
                if hit:
                    break
        if run <= 0:
            run, start, began, matched, total, exact = 0.0, i, i + d, 0.0, 0.0, True
        total += weight[i]
        if hit:
            run += 1
            matched += weight[i]
            if run > top:
                top, best = run, (i - start + 1, matched / total if total else 1.0, began, exact)
        else:
            run -= penalty
            exact = False
    return best


def best_passage(item: list[str], doc: list[str], offset: int, weight: list[float], slack: int) -> tuple[int, float]:
    """(words of the item that the best passage near `offset` spans, share of their weight that is matched)."""
    return locate_passage(item, dict(enumerate(doc)), offset, weight, slack)[:2]


# ---------------------------------------------------------------- the index

_INDEX = "shard bigint, term string, documents bigint, postings binary"
#: A posting is document << 32 | position + _SHIFT; the shift leaves room for an item's offset to be taken off.
_SHIFT = 1 << 24


def build_index(documents: DataFrame, terms: set[str] | None = None) -> DataFrame:
    """(shard, term, documents, postings): the positional postings of `documents` (doc_id, text), for `terms` or for every term.

    A shard is a batch of documents; its row with the empty term holds their ids, the other rows the documents of the shard that have
    the term and all its postings, as 64-bit integers in order. The rows of a shard follow one another. Null ids and texts are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held = [], {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = (len(ids) << 32) + _SHIFT
                ids.append(doc)
                for p, word in enumerate(WORD.findall(text.lower()), at):
                    if wanted is None or word in wanted:
                        if word in held:
                            held[word].append(p)
                        else:
                            held[word] = [p]
            if not ids:
                continue
            lists = [np.array(x, dtype=np.int64) for x in held.values()]
            rows = [np.array(ids, dtype=np.int64).tobytes(), *(x.tobytes() for x in lists)]
            counts = [len(ids), *(int(np.count_nonzero(np.diff(x >> 32))) + 1 for x in lists)]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number] * len(rows), pa.int64()), pa.array(["", *held], pa.string()), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["shard", "term", "documents", "postings"])
            number += 1

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text != ''")
    return cut_lineage(rows.mapInArrow(index, _INDEX))


def _search(items: list[tuple[int, list[str]]], frequency: dict[str, int], least: float, share: float, slack: int):
    documents = max(1, frequency.get("", 1))
    plans = []
    for item_id, words in items:
        weight = [math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in words]
        window, per_window, need = anchor_plan(len(words), least, share)
        anchors = anchor_positions(words, frequency, window, per_window)
        plans.append((item_id, words, weight, window, need, anchors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}
        for batch in batches:
            out: list[tuple] = []
            for number, term, postings in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "postings"))):
                if number != shard:
                    out += _hits(plans, held, least, share, slack)
                    shard, held = number, {}
                held[term] = np.frombuffer(postings, dtype=np.int64)
            yield _found(out)
        yield _found(_hits(plans, held, least, share, slack))

    return search


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["doc_id", "item_id", "position", "words", "exact"])


def _could_hold(present: np.ndarray, weight: np.ndarray, window: int, share: float) -> np.ndarray:
    """could_hold for many documents at once: `present` says for each which words of the item it has, position by position."""
    sums = np.cumsum(np.where(present, weight * (1 - share), -weight * share), axis=1)
    sums = np.concatenate([np.zeros((len(sums), 1)), sums], axis=1)
    lowest = np.minimum.accumulate(sums, axis=1)
    return (sums[:, window:] >= lowest[:, : sums.shape[1] - window]).any(axis=1)


def _hits(plans: list[tuple], held: dict[str, np.ndarray], least: float, share: float, slack: int) -> list[tuple]:
    """(doc_id, item_id, position, words, exact) of the first passage of each item in each document of one shard.

    Documents that lack too many of the rarest terms are left out first, then those that lack too much of the item's weight; only
    in the others are positions intersected.
    """
    if "" not in held:
        return []
    ids = held[""]
    places = {term: (postings >> 32).astype(np.int32) for term, postings in held.items() if term}
    docs = {term: at[np.r_[True, at[1:] != at[:-1]]] for term, at in places.items()}
    out = []
    for item_id, words, weight, window, need, anchors in plans:
        met = np.zeros(len(ids), dtype=np.int32)
        for k in anchors:
            if words[k] in docs:
                met[docs[words[k]]] += 1
        asked = np.flatnonzero(met >= need)
        if not len(asked):
            continue
        present = np.zeros((len(asked), len(words)), dtype=bool)
        where = np.full(len(ids), -1, dtype=np.int32)
        where[asked] = np.arange(len(asked))
        for i, word in enumerate(words):
            if word in docs:
                at = where[docs[word]]
                present[at[at >= 0], i] = True
        asked = asked[_could_hold(present, np.array(weight), window, share)]
        if not len(asked):
            continue
        wanted = np.zeros(len(ids), dtype=bool)
        wanted[asked] = True
        lists = [held[words[k]][wanted[places[words[k]]]] - k for k in anchors if words[k] in held]
        offsets = np.sort(np.concatenate(lists))
        meets = offsets[: len(offsets) - need + 1][offsets[need - 1 :] - offsets[: len(offsets) - need + 1] <= slack]
        if not len(meets):
            continue
        firsts = np.flatnonzero(np.r_[True, np.diff(meets >> 32) != 0])
        for starts in np.split(meets, firsts[1:]):
            document = int(starts[0]) >> 32
            own: dict[int, str] = {}
            for word in set(words):
                if word in held:
                    a, b = np.searchsorted(places[word], [document, document + 1])
                    for p in held[word][a:b].tolist():
                        own[p] = word
            tried = None
            for start in starts.tolist():
                if tried is not None and start - tried <= 1:
                    continue
                tried = start
                spans, part, began, exact = locate_passage(words, own, start, weight, slack)
                if part >= share and spans >= len(words) * least:
                    out.append((int(ids[document]), item_id, (began & 0xFFFFFFFF) - _SHIFT, spans, exact))
                    break
    return out


def search_index(index: DataFrame, items: list[tuple[int, list[str]]], least: float = 1 / 3, share: float = 0.85, slack: int = 12) -> DataFrame:
    """(doc_id, item_id, position, words, exact) of the passages of `items` (id, words), a bounded block, that `index` holds.

    position is the word of the document at which the passage begins, words how many of the item's words it spans, exact whether it
    is an exact phrase rather than a proximity match. The index must cover the words of the items.
    """
    wanted = index.sparkSession.createDataFrame([(w,) for w in sorted({"", *(w for _, words in items for w in words)})], "term string")
    counted = index.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.sum("documents").alias("n"))
    frequency = {r.term: r.n for r in counted.collect()}
    return index.mapInArrow(_search(sorted(items), frequency, least, share, slack), "doc_id bigint, item_id bigint, position bigint, words int, exact boolean")


def find_passages(documents: DataFrame, items: DataFrame, least: float = 1 / 3, share: float = 0.85, slack: int = 12) -> DataFrame:
    """(doc_id, item_id, position, words, exact) of the documents (doc_id, text) that hold a passage of an item (item_id, body).

    A passage spans at least `least` of the item's words, in their order, and matches `share` of them by weight.
    Case, punctuation and line breaks do not matter; repeated rows give repeated rows. Null ids, null and empty texts and items hold
    nothing; an item is found by what its rows share if its id repeats. Other columns of both tables are ignored.
    """
    bodies = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("body").cast("string").alias("body")).where("item_id is not null and trim(body) != ''").distinct()
    chars = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    results = []
    for block in range(blocks):
        rows = bodies.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else bodies
        asked = [(r.item_id, w) for r in rows.collect() if (w := words_of(r.body))]
        index = build_index(documents, {w for _, words in asked for w in words})
        results.append(search_index(index, asked, least, share, slack))
    return reduce(DataFrame.unionByName, results)


def find_leaks(documents: DataFrame, items: DataFrame, least: float = 1 / 3, share: float = 0.85, slack: int = 12) -> DataFrame:
    """(doc_id, item_id), once for each document that holds a passage of an item; see find_passages."""
    return find_passages(documents, items, least, share, slack).select("doc_id", "item_id").distinct()
