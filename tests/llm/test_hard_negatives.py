"""Hard negatives against all pairs, on vectors that lie in clusters (where bounds prune) and on awkward tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from witloom.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<double>, label int, row string, place int, score double"


def brute(rows, mining=hn.Mining()):
    good = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, [math.floor(mining.scale * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, (a, v, label) in enumerate(good):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), b, own) for j, (b, w, own) in enumerate(good) if j != i]
        positives = sorted((s, b) for s, b, own in scored if own == label)[: mining.positives]
        others = sorted((s, b) for s, b, own in scored if own != label)
        for s, b in positives:
            inside = [(t, c) for t, c in others if mining.least * -s <= 100 * -t <= 100 * -s][: mining.negatives]
            out += [(a, b, k, c, -s, -t) for k, (t, c) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, mining=hn.Mining()):
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    out = hn.mine(frame, F.pmod("vec_id", F.lit(100)) == 0, mining, hn.noisy_label())
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(n, seed=1, dims=8, clusters=6):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(k, [m + rnd.gauss(0, 0.02) for m in middles[k % clusters]], (k % clusters if rnd.random() < 0.8 else rnd.randrange(10)), "x", k, 0.5) for k in range(n)]


def test_clusters(spark):
    rows = clustered(2500)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "CHUNK", 100)
    monkeypatch.setattr(hn, "SHARED", 30)
    rows = clustered(1500, seed=2)
    assert mined(spark, rows) == brute(rows)


def test_other_numbers(spark):
    rows, mining = clustered(1200, seed=3), hn.Mining(positives=2, negatives=9, least=35, scale=1000)
    assert mined(spark, rows, mining) == brute(rows, mining)


def test_awkward_rows(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(rnd.choice([3, 4]))], rnd.randrange(3), None, None, None) for k in range(400)]  # ties
    rows += [(100, [1.0, 1.0], 1, "", 0, 0.0)] * 3 + [(200, [0.0], 2, "", 0, 0.0), (300, [-1.0, -1.0], 77, "", 0, 0.0), (None, [1.0], 1, "", 0, 0.0), (400, None, 1, "", 0, 0.0), (500, [1.0, None], 1, "", 0, 0.0)]
    rows += [(600, [float("nan")], 1, "", 0, 0.0), (700, [float("inf")], 1, "", 0, 0.0), (800, [1.0], None, "", 0, 0.0), (900, [], 1, "", 0, 0.0)]
    rows += [(k, [1.0, 1.0, 1.0], 1 if k % 2 else 2, "", 0, 0.0) for k in range(1000, 1400)]  # one very common vector
    assert mined(spark, rows) == brute(rows)


def test_large_scores_stay_exact(spark):
    rnd = random.Random(6)
    rows = [(k, [rnd.randrange(-(2**21), 2**21) + 0.0 for _ in range(3)], k % 2, "", 0, 0.0) for k in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_lone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1, "", 0, 0.0)]) == []
    assert mined(spark, [(1, [1.0], 1, "", 0, 0.0), (2, [1.0], 2, "", 0, 0.0)]) == []


def test_bounds_prune_on_clusters():
    """In tight clusters most candidates lie outside every window, and most scores are never worked out."""
    rows = clustered(4000, seed=8)
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    labels = np.array([k % 6 for k in range(4000)])
    ids = np.arange(4000)
    anchors = np.arange(0, 4000, 20)
    order, parent, edge = hn.spanning_tree(v[anchors])
    assert sorted(order.tolist()) == list(range(200)) and (parent < 0).sum() == 1
    assert np.allclose(edge[1:], [np.linalg.norm(v[anchors[i]] - v[anchors[parent[i]]]) for i in range(1, 200)])
    walk = hn.Walk(hn.Block(anchors, labels[anchors], v[anchors], order, parent, edge), hn.Mining())
    walk.read(ids, ids, labels, v)
    assert walk.scored < 0.3 * walk.met
    for i, a in enumerate(anchors):
        same = (labels == labels[a]) & (ids != a)
        want = sorted(zip(-(v[same] @ v[a]), ids[same], strict=True))[:5]
        assert list(zip(-walk.best[i][0][0], walk.best[i][0][1], strict=True)) == want
