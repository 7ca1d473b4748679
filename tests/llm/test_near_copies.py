"""The pipeline's near-dedup on rows of shared and null ids."""

import random

import corpus_pipeline


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]


def test_rows_of_shared_and_null_ids_stay(spark):
    rnd = random.Random(3)
    prose = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(80)) for _ in range(8)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (5, prose[2]), (5, prose[3]), (3, prose[2]), (7, prose[4]), (7, prose[4]), (None, prose[4]), (8, None), (9, "")]
    want = [(None, prose[0]), (None, prose[1]), (5, prose[3]), (3, prose[2]), (7, prose[4]), (8, None)]
    assert sorted(map(str, kept(spark, rows))) == sorted(map(str, want))


def test_many_equal_rows(spark):
    """Ten thousand equal rows, and as many that share their text alone, are one document; others stay."""
    rnd = random.Random(4)
    prose = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(80)) for _ in range(20)]
    rows = [(3, prose[0])] * 10_000 + [(k + 10, prose[0]) for k in range(10_000)] + [(100_000 + k, t) for k, t in enumerate(prose[1:])]
    assert sorted(i for i, _ in kept(spark, rows)) == [3, *range(100_000, 100_019)]


def test_recall_of_near_copies_and_clean_documents(spark):
    """Copies with one word in a hundred replaced lie above 0.8 and go; documents with words of their own all stay."""
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    rows = []
    for k in range(100):
        base = [word() for _ in range(rnd.randint(100, 500))]
        rows.append((k, " ".join(base)))
        for copy in (1, 2):
            changed = set(rnd.sample(range(len(base)), max(1, len(base) // 100)))
            rows.append((1000 * copy + k, " ".join(word() if i in changed else w for i, w in enumerate(base))))
    assert sorted(i for i, _ in kept(spark, rows)) == list(range(100))
