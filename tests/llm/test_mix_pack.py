import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from witloom.llm import mixing, packing
from witloom.llm.queries import tokenizer_path

# --- mixing ---


def brute_targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; what lies above three times a source's size is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if 3 * sizes[s] < level * weight[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped.update(over)


def made_docs(n=3000):
    rnd = random.Random(4)
    names = ["b", "a", "Z", "é", "z9", "", None, "tiny"]
    rows = []
    for i in range(n):
        s = names[0] if rnd.random() < 0.4 else rnd.choice(names[:-1])
        rows.append((i, " ".join("w" for _ in range(int(rnd.expovariate(0.02)))), s))
    return rows + [(n, "three words here", "tiny"), (n + 1, None, "a"), (7, rows[7][1], rows[7][2]), (n + 2, "w " * 20_000, "Z"), (n + 3, None, "empty")]


def test_mix(spark):
    rows = made_docs()
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string").repartition(5)
    got = mixing.mix(docs, keep=["source"]).collect()
    again = mixing.mix(docs.repartition(3), keep=["source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and np.isclose(r["target"], want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.005 * want[s], 40), (s, taken[s], want[s])
    assert mixing.mix(docs.where("false")).collect() == []


def test_one_source_takes_all_once(spark):
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(50)], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in mixing.mix(docs).collect()} == {(3, 150.0)}


def test_quotas_are_the_highest_quotients(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    votes = {f"p{i}": rnd.randint(0, 5000) for i in range(30)}
    frame = spark.createDataFrame([(k, float(v), 0) for k, v in votes.items()], "name string, votes double, g int")
    got = {r["name"]: r["quota"] for r in mixing.sainte_lague(frame, "votes", F.lit(97), ["g"], ["name"]).collect()}
    ranked = sorted(((-v / (2 * k + 1), name, k) for name, v in votes.items() for k in range(97)))[:97]
    want = Counter(name for _, name, _ in ranked)
    assert {k: v for k, v in got.items() if v} == dict(want)


# --- packing ---


def test_best_fill_matches_brute_force():
    rnd = random.Random(8)
    for _ in range(300):
        capacity = 64
        stock = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(1, 6))}
        rest = rnd.randint(0, 63)
        sums = {0}
        for x, n in stock.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= rest)
        chosen = packing.best_fill(stock, capacity, rest)
        assert all(n <= stock[x] for x, n in chosen)
        total = sum(x * n for x, n in chosen)
        if best == rest:
            assert total == rest
        else:
            used = capacity - rest
            free = [s for s in sums if s <= rest and (used + s) & (used + s - 1) == 0]
            assert total == (max(free) if free else best)


def test_words_encode_as_whole_texts():
    ids = packing.WordIds(tokenizer_path())
    texts = ["Don't stop, it's 3rd! e.g. (x_y) [42]", "ÀÉÎ straße ÿ ¿que? ‘quoted’ …", "a<|endoftext|>b <|x", "\x1c\x85 b　c", "é İΣΣ ﬁ", "'ll 'LL we'Ve 'tis", "#$%&&&\\ ~~{}|", "日本語 テキスト", "\x00\x01 \x7f", "ªº²³ ×÷", "", "ÜBER-maß ß9ü äÄ"]
    for t in texts:
        assert ids.ids_of(pa.array(t.encode().split(), pa.large_binary()))[0].tolist() == ids.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [4096, 32])
def test_pack(spark, capacity):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["alpha", "Beta,", "gamma.", "x1", "über"]) for _ in range(int(rnd.expovariate(0.01)))) for _ in range(400)] + [None, "", " ", "w " * 9000]
    rows = [*enumerate(texts), (3, texts[3]), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(4)
    got = packing.pack(docs, tokenizer_path(), capacity=capacity).collect()
    whole = packing.WordIds(tokenizer_path()).whole
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert sum(r["length"] for r in got) == sum(len(ids[i]) for i, _ in rows)
    places = defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    padded = 0
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(places) == list(range(len(places)))
    assert padded <= max(2 * capacity, 0.005 * sum(len(ids[i]) for i, _ in rows))
    assert packing.pack(docs.where("false"), tokenizer_path()).collect() == []
