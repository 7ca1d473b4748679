"""Diagonal votes against a plain version: every place of every gram, template by template."""

import random
import time
from collections import defaultdict

import pytest

from witloom.llm import license_scan as L


def brute_labels(text):
    """Labels of the method and their best coverage, by the definition of votes, merged diagonals and spans."""
    words, k = L.words_of((text or "").encode()), L.K
    labels, best = set(), 0.0
    for label, template in L.TEMPLATES:
        t = L.words_of(template.encode())
        voters = defaultdict(set)
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    voters[i - j].add(j)
        groups, last = [], None
        for d in sorted(voters):
            if last is None or d - last > L.NEAR:
                groups.append([])
            groups[-1].append(d)
            last = d
        for g in groups:
            if 3 * sum(len(voters[d]) for d in g) >= max(1, len(t) - k + 1):
                low, high = max(0, g[0]), g[-1] + len(t)
                while True:
                    share = L.coverage(words[low : min(high, low + 3 * len(t))], t)
                    if share >= L.COVERED:
                        labels.add(label)
                        best = max(best, share)
                    if low + 3 * len(t) >= high:
                        break
                    low += len(t)
    return labels, best


def worn(rnd, words, share):
    """Words with some dropped, doubled or replaced."""
    out = []
    for w in words:
        x = rnd.random()
        out += [] if x < share / 3 else [w, w] if x < 2 * share / 3 else ["zzz"] if x < share else [w]
    return out


def test_votes_match_brute_force(spark):
    rnd = random.Random(7)
    noise = lambda n: [rnd.choice(["the", "of", "software", "license", "and", "to", "in", "lorem", "any", "or"]) for _ in range(n)]
    texts = []
    for i, (_, template) in enumerate(L.TEMPLATES):
        for share in (0, 0.08, 0.25, 0.6):
            texts.append(" ".join(noise(rnd.randint(0, 30)) + worn(rnd, template.split(), share) + noise(rnd.randint(0, 30))))
        if i % 5 == 0:
            texts.append(" ".join(template.split() * 4))
    texts += [" ".join(noise(300)), "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    found = 0
    for i, t in enumerate(texts):
        labels, best = brute_labels(t)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base, t
        assert got[i]["score"] == pytest.approx(max(best, L.PHRASE_SCORE if base else 0.0))
        found += bool(labels)
    assert found > 0.5 * len(texts)


def test_long_single_line(spark):
    line = "permission to use copy modify and or distribute this software for any purpose " * 20_000
    docs = spark.createDataFrame([(1, line, "clash"), (None, None, None)], "doc_id long, text string, labels string")
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["labels"]) for r in L.scan(docs).collect()}
    assert got[None] == (0, "") and got[1][0] == 13 * 20_000 and time.time() - began < 60
