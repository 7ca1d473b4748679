"""Fill-in-the-middle against slices of decoded texts, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from witloom.llm import fill_middle


def plain(doc_id, text):
    """The contract by slices of the decoded text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def made_rows():
    rnd = random.Random(7)
    rows = [(None, "null id"), (1, None), (2, ""), (3, "a<P>b"), (4, "<M>"), (5, "<S"), (6, "<P<S<M>"), (7, "a\0b"), (8, "😀" * 3000), (9, "é" * 100_000), (9, "same id"), (9, "same id"), (-10, "negative")]
    rows += [(100 + k, "".join(rnd.choice("ab é一😀<PSM>\n") for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    return rows


def test_ends_of_code_points():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab é一😀\n") for _ in range(rnd.randint(0, 60)))
        raw = text.encode()
        ends = fill_middle.Ends(raw)
        want = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert ends.behind(np.arange(len(text) + 1)).tolist() == want
        assert ends.before(np.array(want)).tolist() == list(range(len(text) + 1))


def test_table(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, output string, h1_ string").repartition(3)
    done = fill_middle.transform(docs)
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = done.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got))) == sorted(str((i, *plain(i, t), t or "")) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(p := plain(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(str, map(tuple, fill_middle.digests(docs).collect()))) == sorted(map(str, want))
    assert fill_middle.digests(docs.where("false")).count() == 0


def test_other_markers_and_columns(spark):
    forms = fill_middle.Forms("[fim-p]", "[fim-s]", "[fim-m]", seed=5, changed=100, suffix_first=50)
    docs = spark.createDataFrame([(k, f"naïve {k} [x] text", "kept") for k in range(50)], "doc_id long, body string, text string")
    done = fill_middle.transform(docs, forms, "body").withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), forms)).collect()
    assert {r["form"] for r in done} == {"psm", "spm"}
    assert all(r["back"] == f"naïve {r['doc_id']} [x] text" and r["text"] == "kept" for r in done)
    with pytest.raises(ValueError, match="markers"):
        fill_middle.Forms("<P>", "<P>", "<M>")
