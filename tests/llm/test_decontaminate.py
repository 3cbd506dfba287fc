"""Wu-Manber search against direct comparison at every place."""

import random

from memlake.llm import decontaminate as d


def brute(text, items, size=10):
    text, hit, found = d.words(text), set(), set()
    for item_id, item in items:
        for w in set(d.windows(d.words(item), size)):
            for i in range(len(text) - len(w) + 1):
                if tuple(text[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add("null" if item_id is None else str(item_id))
    return len(text), len(hit), len(found), d.digest(list(found))


def test_search_matches_brute_force(spark, make):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 11, 14]))) for i in range(12)] + [(50, say(10)), (50, say(12)), (60, ""), (61, None), (62, "!? 	"), (None, say(2))]
    texts = [(i, say(rng.choice([0, 5, 40, 300]))) for i in range(40)] + [(99, None), (100, "A, b; C... " * 9), (101, "é 9a " + items[3][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {i: brute(t, items) for i, t in texts}
    for limit in (100_000, 7):  # one part, and several
        found = {r.doc_id: r for r in d.search(make(texts), bench, limit=limit).select("doc_id", "__n_words", "__spans", "__items").collect()}
        for i, r in found.items():
            spans = list(zip(r["__spans"][::2], r["__spans"][1::2]))
            assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
            assert (r["__n_words"], sum(b - a for a, b in spans), len(r["__items"]), d.digest(r["__items"])) == want[i]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in d.contamination(make(texts), bench).collect()}
    assert got == want


def test_odd_texts_and_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11")], "item_id bigint, text string")
    got = {r.doc_id: r for r in d.contamination(odd, bench).collect()}
    assert got[8].contaminated and not got[4].contaminated and got[8].n_hit == 11 * len(range(1, 60_000 - 10, 977))
    assert d.contamination(odd, bench.where("false")).where("contaminated").count() == 0
    assert d.contamination(empty, bench).count() == 0
    kept = d.redact(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id IN (8, 9)").count() == 0 and kept.count() == odd.count() - 2


def test_shift_table_jumps():
    w = d.WuManber.build(10, {tuple("abcdefghij"): [1]})
    assert w.shift[("i", "j")] == 0 and w.shift[("a", "b")] == 8
    assert list(w.find(list("xxabcdefghijabcdefghij"))) == [(2, [1]), (12, [1])]
