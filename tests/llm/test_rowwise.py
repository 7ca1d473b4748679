import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from witloom.llm import html_extract, license_scan, qda, quality_rules, topk

WHITE = " \t\n\x0b\x0c\r"


def ascii_words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def odd_texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abceé#$") for _ in range(rnd.randint(1, 5)))
    prose = " ".join(word() for _ in range(50))
    texts = [None, "", " \n\t", "one", prose, prose + "\n" + prose, "the of and\n" * 12, "a\x0bb\x1cc d", "w " * 30_000, "\n\n x\n\nx\n x", "1 2 3 4 5 6 7 8 " * 2 + "9", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0"]
    return texts + [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(10)]


# --- quality rules ---


def brute_rules(text):
    text = text or ""
    words = ascii_words(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if ascii_words(x)]
    n, chars, symbols, dup, rep = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    base = n < 20 or 100 * rep > 30 * n
    stop = sum(w in set(quality_rules.STOP_WORDS) for w in words)
    good = 2 * n <= chars <= 14 * n and 100 * symbols <= 25 * n and 100 * stop >= 2 * n and 100 * dup <= 30 * len(lines) and 20 <= n <= 200_000
    return n, chars, symbols, dup, rep, base, not base and good


def test_quality_rules(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "x", "x", 1)], "doc_id long, text string, words string, n_words int")
    got = {r["doc_id"]: tuple(r)[1:8] for r in quality_rules.judge(docs).collect()}
    assert got == {**{i: brute_rules(t) for i, t in enumerate(texts)}, None: brute_rules("x")}
    assert quality_rules.judge(docs.where("false")).collect() == []


# --- html ---


PAGES = [
    ("<html><head><title>No</title></head><body><nav><ul><li><a href=/>menu</a></ul></nav><article><h1>A &amp; B</h1><p>One   two<b>three</b>,\n four.<p>Five&nbsp;six &lt;x&gt; <br>seven.</article><footer>foot, of page</footer>", "A & B\nOne twothree, four.\nFive six <x> seven."),
    ("<body><div class='content'><h2>Head</h2><p>Long text, with marks; and more of it. And so on, for a while, it goes.</p><p>Short.</p><p>Again a long text, with marks; and more of it, for a while.</p></div><div id=sidebar>Side text, side text.</div><div class='comments'><p>I agree, really; good text, of some length.</p></div></body>", "Head\nLong text, with marks; and more of it. And so on, for a while, it goes.\nShort.\nAgain a long text, with marks; and more of it, for a while."),
    ("<article><p>Cut off in a <a hre", "Cut off in a"),
    ("<article><p>x<script>var t='</p>';</script>y<!-- <p>no</p> -->z<form><input>Name</form></article>", "xyz"),
    ("<main><p>p1 text.</p><ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table></main>", "p1 text.\ni1\ni2\nc1\nc2"),
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<p", ""),
    ('<article class="x"><p title="a>b">in "quotes"</p></article>', 'in "quotes"'),
    ('<article><p title="open>in broken quotes</p></article>', "in broken quotes"),
]


def test_html(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "c") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string").repartition(2)
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got == {i: (f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.extract(pages.where("false")).collect() == []


# --- licenses ---


def brute_license(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    filler = "lorem ipsum dolor sit amet consetetur " * 20
    texts = [
        *odd_texts(),
        filler + "Released under the MIT License. " + filler,
        "MIT license, mit-LICENSE; Apache License! the general public license",
        filler + "Licensed under CC BY-NC 4.0. " + filler,
        filler + license_scan.TEMPLATES[2][1].replace("granted", "hereby granted").replace("free of charge,", "") + filler,
        "permission is hereby " * 50,
        "Kmit license ſ",
        ("Released under the MIT License.\n" * 400),
    ]
    rows = [*enumerate(texts), (0, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k1 string").repartition(3)
    got = license_scan.scan(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == sorted((i, *brute_license(t)) for i, t in rows)
    labels, n = {r["doc_id"]: (r["labels"], r["score"]) for r in got}, len(odd_texts())
    assert labels[n] == ("mit", 1.0) and labels[n + 1] == ("apache,gpl,mit", 0.5) and labels[n + 2] == ("cc-by-nc", 1.0)
    assert labels[n + 3][0] == "mit" and 0.8 <= labels[n + 3][1] < 1 and labels[n + 4] == ("", 0.0) and labels[n + 6] == ("mit", 1.0)
    assert license_scan.scan(docs.where("false")).collect() == []


# --- top k ---


@pytest.mark.parametrize("sizes", [(16_384, 1_024), (40, 2)])
def test_top_k(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", sizes[1])
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "FLOOR_ROWS", 30)
    rnd = np.random.default_rng(1)
    vectors = [(i * 10, (rnd.integers(-3, 4, 6) / 4).tolist()) for i in range(200)]
    vectors += [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] + [0.0] * 5), (100, vectors[10][1]), (2100, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(3)
    good = [(i, np.pad(np.floor(1024 * np.array(v, np.float32).astype(float)), (0, 6 - len(v)))) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = []
    for q, (i, v) in enumerate(good):
        if i % 100 == 0:
            scores = sorted((-int(v @ w), j) for d, (j, w) in enumerate(good) if d != q)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    queries = F.expr("pmod(vec_id, 100) = 0")
    got = topk.top_k(frame, queries)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(frame.where("false"), queries).collect() == []


def test_large_products_stay_exact():
    q, d = np.array([[2.0**30, 3.0]]), np.array([[2.0**29, 5.0]])
    assert topk._products(q, d)[0, 0] == 2**59 + 15
    with pytest.raises(ValueError):
        topk._products(q * 2.0**10, d)
    rows = np.arange(40)
    d = np.array([[2.0**29, float(i % 7)] for i in range(40)])
    found, _ = topk.search_shard(np.array([0]), np.array([0]), q, rows, rows, d, 5, np.array([-np.inf]))
    want = sorted(((-(2**59 + 3 * (i % 7)), i) for i in range(1, 40)))[:5]
    assert sorted(zip(found[3].tolist(), found[2].tolist(), strict=True)) == sorted((-s, i) for s, i in want)


# --- quality classifier ---


def test_classifier(spark):
    rnd = random.Random(2)
    clean = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8))) + rnd.choice(["", "", ","]) for _ in range(rnd.randint(30, 200)))
    junk = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8))) + rnd.choice(["###", "$$$", "&&"]) for _ in range(rnd.randint(30, 200)))
    rows = [(i, clean() if i % 3 else junk(), "en") for i in range(300)] + [(300, None, "en"), (None, "x", "en"), (301, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (1, None, 0), (301, 1, 0)], "doc_id long, quality int, toxic int")
    got = qda.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1)
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(right) / len(right) > 0.97
    again = {r["doc_id"]: r["score"] for r in qda.classify(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    alone = qda.classify(docs, labels.where("false")).collect()
    assert {r["score"] for r in alone} == {0.5}


def test_discriminant_by_hand(spark):
    rnd = np.random.default_rng(0)
    d = len(qda.STATISTICS)
    x = [rnd.normal(0, 1, (40, d)), rnd.normal(1, 2, (60, d))]
    frame = spark.createDataFrame([(v.tolist(), k) for k in (0, 1) for v in x[k]], "x array<double>, label int")
    model = qda.fit(frame, alpha=0.3, gamma=0.1)
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (40 * cov[0] + 60 * cov[1]) / 100
    p = x[0][0]
    logs = []
    for k in (0, 1):
        s = 0.9 * (0.7 * cov[k] + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled))
        e = p - x[k].mean(axis=0)
        logs.append(-0.5 * e @ np.linalg.inv(s) @ e - 0.5 * np.log(np.linalg.det(s)) + np.log(len(x[k])))
    assert np.isclose(qda.score_rows(model, p[None])[0], 1 / (1 + np.exp(logs[0] - logs[1])))
