"""Leaked passages against a reading of every pair."""

from patrika.llm.leakage import anchor_plan, anchor_positions, best_passage, build_index, could_hold, find_leaks, find_passages, search_index, words_of
from patrika.sources.tables import read_table

ITEM = "Gunador buys 251 kg of cardamom at 41 coins, spoils a fifth in the tithe barn, and sells the rest to Vunubas at a gain of 7 per cent on the river quay near Sapuyogiria."


def test_anchors_fill_every_window():
    words = words_of(ITEM)
    frequency = {w: len(w) * 7 % 11 for w in words}
    window, most, needed = anchor_plan(len(words), 1 / 3, 0.85)
    chosen = set(anchor_positions(words, frequency, window, most))
    assert needed <= most
    for s in range(len(words) - window + 1):
        assert len(chosen & set(range(s, s + window))) >= most


def test_cases(spark):
    cut = " ".join(ITEM.split()[:16])
    docs = [
        (1, f"Before it. {ITEM} After it."), (2, f"x {cut.upper().replace(' ', chr(10))} y"), (3, ITEM.replace("spoils", "wastes").replace("gain", "profit")),
        (4, ITEM.replace("Gunador", "Other").replace("251", "88").replace("cardamom", "flax").replace("41", "19").replace("Vunubas", "Name").replace("tithe barn", "map room").replace("Sapuyogiria", "Elsewhere").replace("7", "3").replace("river quay", "old mill")),
        (5, " ".join(ITEM.split()[:8])), (6, None), (7, ""), (8, "w " * 100_000), (1, f"Before it. {ITEM} After it."),
    ]
    noise = [(100 + i, "the rest of the coins is in the barn, and a gain of some per cent at the quay near the river in a fifth of the cases sells") for i in range(60)]
    documents = spark.createDataFrame([(d, t, 1) for d, t in docs + noise], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x")], "item_id bigint, body string, text string")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(documents, items).collect())
    assert got == [(1, 1), (2, 1), (3, 1)]
    assert find_leaks(documents.limit(0), items).count() == 0
    assert find_leaks(documents, items.limit(0)).count() == 0


def test_one_index_answers_other_items(spark):
    """The index of all terms is asked for two sets of items and gives where each passage begins and whether it is exact."""
    other = "The ferryman of Talabu counts 63 lanterns before dawn and lends nine of them to the glass smith for a week in Lent."
    documents = spark.createDataFrame([(1, f"One two three. {ITEM}"), (2, f"Three, {other.replace('counts', 'numbers')} four"), (3, "nothing of it"), (None, ITEM)], "doc_id bigint, text string")
    index = build_index(documents)
    first = [tuple(r) for r in search_index(index, [(7, words_of(ITEM))]).collect()]
    assert first == [(1, 7, 3, len(words_of(ITEM)), True)]
    second = [tuple(r) for r in search_index(index, [(8, words_of(other))]).collect()]
    assert second == [(2, 8, 1, len(words_of(other)), False)]
    items = spark.createDataFrame([(7, ITEM), (8, other)], "item_id bigint, body string")
    assert sorted(tuple(r) for r in find_passages(documents, items).collect()) == first + second


def test_index_equals_every_pair(spark, folder):
    """Reading every item against every document at every offset finds nothing that the index misses."""
    documents, items = read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items").where("item_id < 12")
    got = {(r.doc_id, r.item_id) for r in find_leaks(documents, items).collect()}
    import math

    texts = {r.doc_id: words_of(r.text) for r in documents.collect()}
    bodies = {r.item_id: words_of(r.body) for r in items.collect()}
    seen = {w for b in bodies.values() for w in b}
    frequency = {w: 0 for w in seen}
    for words in texts.values():
        for w in seen & set(words):
            frequency[w] += 1
    want = set()
    for i, body in bodies.items():
        weight = [math.log((len(texts) + 1) / (frequency[w] + 1)) + 0.01 for w in body]
        window = math.ceil(len(body) / 3)
        for d, words in texts.items():
            if not could_hold(body, set(words), weight, window, 0.85):
                continue
            places = {}
            for p, x in enumerate(words):
                places.setdefault(x, []).append(p)
            offsets = {p - k for k, w in enumerate(body) for p in places.get(w, ())}
            if any(s >= len(body) / 3 and share >= 0.85 for s, share in (best_passage(body, words, o, weight, 12) for o in offsets)):
                want.add((d, i))
    assert got == want
