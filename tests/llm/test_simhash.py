import random

import numpy as np
import pytest

from witloom.llm import simhash as sh


def brute_components(prints):
    """Least doc_id reachable over links of at most three differing bits; prints: (doc_id, fingerprint)."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc)
    return {(doc, fp): min(groups[root(i)]) for i, (doc, fp) in enumerate(prints)}


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d", b"b c d"[:0] + b"c d a")]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert sh.fingerprint(b"A  b\tC d\na") == want
    assert sh.fingerprint(b" ") == 0
    assert sh.fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert sh.fingerprint(b"x y z") == xxhash.xxh64_intdigest(b"x y z", 42)


def near_prints(rnd, n):
    out = []
    for _ in range(n):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 5)):
            for _ in range(rnd.randint(0, 4)):
                base ^= 1 << rnd.randrange(64)
            out.append(base)
    return out


def test_traversal_finds_all_links():
    rnd = random.Random(5)
    values = np.unique(np.array([x & 0xFFFFFFFFFFFF | 7 << 48 for x in near_prints(rnd, 400)], np.uint64))
    zero = np.array([0])
    found = set()
    for i, j in sh.linked_pairs(values, [zero, zero + len(values), zero, zero + len(values), zero], 16, 3, brute=4):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert found == want


@pytest.mark.parametrize("leaf", [4096, 6])
def test_links_connect_what_links(spark, leaf):
    rnd = random.Random(leaf)
    prints = sorted({x & (2**64 - 1) for x in near_prints(rnd, 150)} | {(0xABCD << 48) | x & 0xFFFF for x in near_prints(rnd, 60)})
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    edges = sh.links(spark.createDataFrame([(x,) for x in signed], "fp long"), leaf=leaf)
    got = sh.components(edges, spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "node long, weight long"))
    got = {r["node"]: r["component"] for r in got.collect()}
    want = brute_components(list(enumerate(prints)))
    assert {x: got.get(s, i) for i, (x, s) in enumerate(zip(prints, signed, strict=True))} == {fp: c for (_, fp), c in want.items()}


def test_query_matches_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rnd.randint(1, 120))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            words = [*words]
            words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += [None, "", " \n ", "one", "one two", texts[0], texts[0].upper(), "w " * 30_000]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(tuple(r) for r in sh.near_duplicates(docs).collect())
    prints = [(i + 10, sh.fingerprint((t or "").encode())) for i, t in rows]
    want = brute_components(prints)
    assert got == sorted((d, f"{fp:016x}", want[d, fp]) for d, fp in prints)


def test_empty_and_null_ids(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = sh.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "alone in here now")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None")]
