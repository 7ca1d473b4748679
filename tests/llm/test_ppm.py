import random
import zlib
from collections import Counter
from math import isclose, log10

import pytest

from witloom.llm import ppm


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(rows):
    trie, words, n_docs = ppm.Trie(), Counter(), 0
    for doc, text in rows:
        if not held(doc):
            trie.learn((text or "").encode())
            words.update((text or "").encode().lower().split())
            n_docs += 1
    n, v = sum(words.values()) + n_docs, len(words) + bool(n_docs)
    out = []
    for doc, text in rows:
        tokens = (text or "").encode().lower().split()
        counts = [words[w] for w in tokens] + [n_docs]
        base = sum(log10((c + 1) / (n + (v + 1))) for c in counts)
        out.append((doc, held(doc), len(counts), sum(c > 0 for c in counts), n, base, trie.score((text or "").encode())))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß0,") for _ in range(rnd.randint(1, 5)))
    common = [word() for _ in range(30)]
    rows = [(i, " ".join(rnd.choice(common) if rnd.random() < 0.8 else word() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "日本 \x00 new"), (63, " \n"), (None, "null id"), (5, rows[5][1]), (64, "a" * 5000)]


@pytest.mark.parametrize("heads", [(1 << 20, 1 << 18), (40, 5), (0, 0)])
def test_query_matches_brute_force(spark, heads):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(4)
    got = sorted((tuple(r) for r in ppm.score(docs, head_grams=heads[0], head_words=heads[1]).collect()), key=str)
    for g, w in zip(got, brute(rows), strict=True):
        assert g[:5] == w[:5]
        assert isclose(g[5], w[5], rel_tol=1e-9) and isclose(g[6], w[6], rel_tol=1e-9), (g, w)


def test_no_training_rows(spark):
    doc = next(i for i in range(100) if held(i))
    row = ppm.score(spark.createDataFrame([(doc, "ab")], "doc_id long, text string")).collect()[0]
    assert isclose(row["score"], -3 * log10(257)) and row["train_tokens"] == 0 and row["n_known"] == 0
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_adaptive_learns(spark):
    docs = spark.createDataFrame([(1, "abcabc" * 50), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score_adaptive(docs).collect()}
    assert got[1] > -120 and isclose(got[2], -log10(257))


def test_probabilities_sum_to_one():
    trie = ppm.Trie(2)
    for t in (b"abracadabra", b"abba", b"cab"):
        trie.learn(t)
    for context in ((97, 98), (256, 256), (98, 98), (1, 2), (114, 97)):
        assert isclose(sum(10 ** trie.log10p(context, s) for s in range(ppm.SYMBOLS)), 1, rel_tol=1e-9)
