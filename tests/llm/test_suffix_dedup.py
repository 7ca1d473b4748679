import hashlib
import random

import numpy as np
import pytest

from witloom.llm import suffix_dedup as sd


def brute_mask(texts, length):
    """The contract, literally: a byte goes if a string of ``length`` bytes over it starts anywhere else too."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                masks[i][p : p + length] = True
    return masks


def made_texts(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(60) for _ in range(4)]
    texts = []
    for i in range(n):
        t = prose(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            t += rnd.choice(["", " ", "x"]) + p[a : a + rnd.randint(50, len(p))] + prose(rnd.randint(0, 20))
        texts.append(t)
    texts += [texts[0], texts[1], "a" * 700, "ab" * 300, "", None, "short", passages[0][:200], passages[0][1:201], prose(40) + "a" * 230]
    return texts


def test_transform_matches_brute_force():
    for seed in range(5):
        texts = [(t or "").encode() for t in made_texts(seed, 12)]
        for got, want in zip(sd.repeated_bytes(texts, 60), brute_mask(texts, 60), strict=True):
            assert (got == want).all()


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), t, m in zip(rows, texts, brute_mask(texts, length), strict=True):
        rest = bytes(b for b, gone in zip(t, m, strict=True) if not gone)
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(m.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,limit", [(1, 20_000), (2, 3)])
def test_query_matches_brute_force(spark, seed, limit):
    rows = list(enumerate(made_texts(seed)))
    rows.append((3, rows[3][1]))  # a repeated row
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, low string").repartition(3)
    got = sorted((tuple(r) for r in sd.dedup(docs, limit=limit).collect()), key=str)
    assert got == expected(rows, 200)


def test_empty(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_output_keeps_columns(spark):
    t = "é" * 300
    docs = spark.createDataFrame([(1, t, "s"), (2, "own " + t, "s")], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r["text"] for r in sd.dedup(docs, keep=["doc_id", "source"], as_text=True).collect()}
    assert rows == {1: "", 2: "own "}
