"""The pipeline's mixing emits whole documents."""

import random
from collections import Counter, defaultdict

import corpus_pipeline

from .test_mix_pack import brute_targets


def test_mixed_texts_are_whole(spark):
    rnd = random.Random(2)
    rows = [(i, f" d{i}\n" + "\t ".join(f"w{k}." for k in range(rnd.randint(20, 90))) + " end\n", "en", f"s{i % 6}") for i in range(240)]
    texts = {r[0]: r[1] for r in rows}
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    cut = defaultdict(int)
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    for r in got:
        if r["text"] != texts[r["doc_id"]]:
            assert texts[r["doc_id"]].startswith(r["text"]) and r["text"].strip()
            cut[r["source"]] += 1
    # Small sources are one shard: at most one document is cut in each.
    assert max(cut.values()) == 1
    sizes, words = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    for r in got:
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 1 for s, t in brute_targets(sizes).items())
