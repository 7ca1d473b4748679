"""Mixing sources smaller than a block."""

from collections import Counter

from witloom.llm import mixing

from .test_mix_pack import brute_targets


def test_tiny_sources_meet_their_targets(spark):
    rows = [(i, "w " * 500, "big") for i in range(40)] + [(100 + i, "a b c", f"t{i % 7}") for i in range(21)] + [(200, "w " * 700, "u"), (201, "w " * 333, "u")]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for whole in (False, True):
        taken = Counter()
        # Blocks of some 700 words, as in a large corpus.
        for r in mixing.mix(docs, blocks=30, keep=["source"], whole=whole).collect():
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        for s, target in brute_targets(sizes).items():
            assert abs(taken[s] - target) <= 1, (s, taken[s], target)
