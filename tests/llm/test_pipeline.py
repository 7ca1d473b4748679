"""The pipeline's stages on a small table, each against a plain version of what it should do to its own input."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np

from witloom.llm import packing, qda
from witloom.llm.queries import tokenizer_path

from .test_mix_pack import brute_targets
from .test_similar import plain as near_groups
from .test_suffix_dedup import brute_mask


def made(spark, path):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", ",", "."]) for _ in range(n))
    passage = prose(60)
    rows = []
    for i in range(90):
        text = prose(rnd.randint(40, 150))
        if i % 6 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 9 == 0:
            text = prose(20) + " " + passage + " " + prose(20)
        rows.append((i, text, "en", f"s{i % 4}" if i % 11 else None))
    rows += [(90, rows[1][1], "en", "s1"), (91, rows[2][1] + " more", "en", "s2"), (92, None, "en", "s0"), (93, "", None, "s0"), (5, rows[5][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 > 0), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    made(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [[r.asDict() for r in frame.collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert frame.columns == corpus_pipeline.COLUMNS
        steps.append([r.asDict() for r in frame.collect()])
    docs, good, single, cut, mixed, packed = steps
    # 1: junk goes, clean documents stay.
    assert all("###" not in (r["text"] or "") for r in good)
    assert {r["doc_id"] for r in docs if r["text"] and "###" not in r["text"]} <= {r["doc_id"] for r in good}
    assert len(qda.STATISTICS) == 12
    # 2: the least id of each group stays, once: fingerprints within three bits, or 0.8 of the shingles of five words.
    ordered = sorted(good, key=lambda r: r["doc_id"])
    groups = near_groups([r["text"] or "" for r in ordered])
    assert sorted(r["doc_id"] for r in single) == sorted(ordered[k]["doc_id"] for k in set(groups.values()))
    assert 91 not in {r["doc_id"] for r in single}
    # 3: repeats of 200 bytes go.
    texts = [(r["text"] or "").encode() for r in single]
    want = {r["doc_id"]: bytes(b for b, gone in zip(t, m, strict=True) if not gone).decode("utf-8", "ignore") for r, t, m in zip(single, texts, brute_mask(texts, 200), strict=True)}
    assert {r["doc_id"]: r["text"] for r in cut} == want and any(len(want[r["doc_id"]]) < len(r["text"] or "") for r in single)
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    # 4: words come near the targets; no document comes more than three times.
    sizes, got, copies = Counter(), Counter(), Counter()
    for r in cut:
        sizes[r["source"]] += len(r["text"].split())
    for r in mixed:
        got[r["source"]] += len(r["text"].split())
        copies[r["doc_id"]] += 1
    for s, target in brute_targets(sizes).items():
        assert abs(got[s] - target) <= max(3, 0.01 * target)
    assert max(copies.values()) <= 3
    # 5: every id of every text lies in one piece.
    whole = packing.WordIds(tokenizer_path()).whole
    total = Counter()
    for r in mixed:
        total[r["doc_id"]] += len(whole.encode(r["text"], add_special_tokens=False).ids) + 1
    mine = Counter()
    for r in packed:
        mine[r["doc_id"]] += r["length"]
    assert mine == total
    assert np.all(np.array([r["offset"] + r["length"] for r in packed]) <= 4096)


def test_run_is_the_stages(spark, tmp_path):
    made(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
