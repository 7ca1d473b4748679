"""Candidate pairs of near copies: few in a family whose members don't link, and no link lost."""

import random

import numpy as np
from pyspark.sql import functions as F

from witloom.llm import similar, simhash

from .test_similar import plain


def family(size, seed=11):
    """Copies of one text of 150 words: one in three with one or two words replaced, the others with five to twelve (none of these link)."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    base = [word() for _ in range(150)]
    texts = []
    for k in range(size):
        changed = set(rnd.sample(range(150), rnd.randint(1, 2) if k % 3 == 0 else rnd.randint(5, 12)))
        texts.append(" ".join(word() if i in changed else w for i, w in enumerate(base)))
    return texts


def grouped(spark, texts, monkeypatch):
    """The ids kept, and the number of pairs whose shingle sets were compared."""
    made = []
    exact = similar._verified
    counted = lambda pairs, *rest: made.append(pairs.count()) or exact(pairs, *rest)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = docs.select("*", F.col("doc_id").alias("k_"), F.lit(0).cast("long").alias("b_"))
    with monkeypatch.context() as patched:
        patched.setattr(similar, "_verified", counted)
        kept = sorted(r["k_"] for r in simhash.representatives(docs, least=0.8).collect())
    return kept, sum(made)


def test_pairs_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "LARGE", 16)
    for size in (100, 200):
        texts = family(size)
        kept, pairs = grouped(spark, texts, monkeypatch)
        assert kept == sorted(set(plain(texts).values()))
        assert len(kept) > size / 2
        assert pairs <= 3 * size


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Words of a few only, and words left out: shingles of the changed places are shared, so that groups are chains."""
    monkeypatch.setattr(similar, "LARGE", 16)
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        share = rnd.choice([0.005, 0.02, 0.05])
        texts.append(" ".join(rnd.choice(["x", "y"]) if rnd.random() < share else w for w in base if rnd.random() >= share / 2))
    texts = sorted(set(texts))
    kept, _ = grouped(spark, texts, monkeypatch)
    assert kept == sorted(set(plain(texts).values()))


def test_parities_never_differ_in_more_places_than_shingles():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(0, 400), np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 200), np.uint64)])
        (n, x), (m, y) = similar.parities(np.concatenate([a, a[:5]])), similar.parities(b)
        apart = np.bitwise_count(np.array(x).view(np.uint64) ^ np.array(y).view(np.uint64)).sum()
        assert (n, m) == (len(set(a.tolist())), len(set(b.tolist())))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        assert len(x) == similar.BITS // 64
