"""Near copies of five-word similarity 0.8 or more, against all pairs."""

import random

from pyspark.sql import functions as F

from witloom.llm import similar, simhash

from .test_simhash import brute_components


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(texts):
    """Least index of each group: fingerprints within three bits, or 0.8 of the shingles of five words."""
    label = {i: least for (i, _), least in brute_components([(i, simhash.fingerprint(t.encode())) for i, t in enumerate(texts)]).items()}
    sets = [shingles(t) for t in texts]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if label[i] != label[j] and a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    changed = True
    return label


def made():
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    texts = []
    for _ in range(10):
        base = [word() for _ in range(rnd.randint(60, 400))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.06):
            texts.append(" ".join(word() if rnd.random() < share else w for w in base))
    # A template that many different texts share: candidates that don't link, more than the first rounds' leaders.
    frame = [word() for _ in range(90)]
    texts += [" ".join(frame + [word() for _ in range(22)]) for _ in range(30)]
    # A chain: neighbours link, ends don't.
    chain = [word() for _ in range(120)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[5:] + [word() for _ in range(5)]
    return [*texts, "", "a b", "a b", "a c", "one two three four five"]


def test_groups_are_those_of_all_pairs(spark):
    texts = made()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = docs.select("*", F.col("doc_id").alias("k_"), F.lit(0).cast("long").alias("b_"))
    kept = sorted(r["k_"] for r in simhash.representatives(docs, least=0.8).collect())
    assert kept == sorted(set(plain(texts).values()))
    assert len(kept) < len(set(brute_components([(i, simhash.fingerprint(t.encode())) for i, t in enumerate(texts)]).values()))


def test_bands_of_no_shingles_and_of_many():
    assert similar.bands(simhash.np.array([], "u8")) == []
    many = simhash.np.arange(10_000, dtype="u8") * simhash.np.uint64(0x9E3779B97F4A7C15)
    assert similar.bands(many) == similar.bands(many[::-1]) and len(set(similar.bands(many))) == similar.BANDS
