import random
import re

import numpy as np

from quire.llm.leaks import clean_documents, leaked_items, leaked_passages, shard_matches, suffix_array

DOC = "doc_id long, text string, item_id int"
ITEM = "item_id long, text string, doc_id int"


def words(t):
    t = re.sub("[ـً-ٰٟ]", "", (t or "").lower())
    return re.findall(r"[^\W_]+", t)


def brute(docs, items, k):
    out = {}
    for d, t, _ in docs:
        for i, x, _ in items:
            a, b = words(t), words(x)
            best = 0
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    best = max(best, n)
            if best >= k:
                out[d, i] = best
    return out


def test_suffix_array_orders_like_tuples():
    rng = np.random.default_rng(1)
    for words, k in ((4, 3), (2, 8), (30, 1), (2, 1)):
        ids = rng.integers(0, words, 400)
        ids[-1] = ids[0] = 0
        ends = [next(j for j in range(i, 400) if ids[j] == 0) for i in range(400)]
        want = [i for i in range(400) if ends[i] - i >= k]
        sa = suffix_array(ids, k).tolist()
        tup = [tuple(ids[i : ends[i]]) for i in sa]
        assert sorted(sa) == want and tup == sorted(tup)
    assert len(suffix_array(np.zeros(3, int), 1)) == 0


def test_repeated_words_give_few_pairs():
    ids = np.array([0] + [1] * 3000 + [0])
    n, longest = 0, 0
    for a, _, length in shard_matches(ids, ids, 12, 500):
        n, longest = n + len(a), max(longest, length.max())
    assert n < 7000 and longest == 3000


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocab = ["one", "two", "three", "four", "قال", "كان", "été"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(30), 1) for i in range(6)] + [(90, None, 1), (91, "", 1), (92, "one two", 1)]
    docs = [(i, text(40), 1) for i in range(20)]
    for i in range(20, 30):
        x = items[i % 6][1].split()
        a = rng.randrange(10)
        docs.append((i, text(5) + "! " + ", ".join(w.upper().replace("قال", "قَـالَ") for w in x[a : a + rng.choice([7, 8, 15])]) + " -- " + text(5), 1))
    docs += [(50, None, 1), (51, "", 1), (52, items[0][1], 1), docs[20]]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id): r.n_words for r in leaked_passages(d, i, 8).collect()}
    assert got == brute(docs, items, 8) and (52, 0) in got
    assert got == {(r.doc_id, r.item_id): r.n_words for r in leaked_passages(d, i, 8, block_words=60).collect()}
    r = next(r for r in leaked_passages(d, i, 8).collect() if r.doc_id == 52 and r.item_id == 0)
    assert (r.n_words, r.doc_word, r.item_word) == (30, 0, 0)
    assert {r.doc_id for r in clean_documents(d, i, 8).collect()} == {x[0] for x in docs} - {k for k, _ in got}
    assert leaked_items(d, i, 8).count() == len({k for _, k in got})
    assert leaked_passages(d.limit(0), i).collect() == [] and leaked_passages(d, i.limit(0)).collect() == []
