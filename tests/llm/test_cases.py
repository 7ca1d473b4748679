"""The pipeline's stages and the classifier on null and shared ids, extra columns, very long texts and empty tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from witloom.llm import packing, qda
from witloom.llm.queries import tokenizer_path

from .test_mix_pack import brute_targets
from .test_suffix_dedup import brute_mask

#: Names that the stages use inside, as further columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, k_ int, at_ string, row_ int, x double, score string, low int"


def rows_of(seed=5):
    rnd = random.Random(seed)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passage = prose(60)
    rows = [(None, prose(70)), (None, prose(80)), (None, passage + " " + prose(30)), (5, prose(50)), (5, prose(60)), (6, prose(20) + " " + passage), (7, None), (8, ""), (9, prose(3000)), (None, None)]
    return [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), 1, "a", 2, "b", 3, 0.5, "c", 4) for k, (i, t) in enumerate(rows)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


def texts(frame):
    return Counter((r["doc_id"], r["text"] or "") for r in frame.collect())


def test_quality_keeps_unlabelled_and_shared_ids(spark, docs, tmp_path):
    spark.createDataFrame([(5, 1, 0), (9, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    # One class alone: the score is its share, so every row stays, once.
    assert texts(out) == Counter((r[0], r[1] or "") for r in rows_of())


def test_suffix_stage_by_row(spark, docs):
    out = corpus_pipeline.suffix_repeats(spark, docs, "")
    raw = [(r[1] or "").encode() for r in rows_of()]
    want = Counter((r[0], bytes(b for b, gone in zip(t, m, strict=True) if not gone).decode("utf-8", "ignore")) for r, t, m in zip(rows_of(), raw, brute_mask(raw, 200), strict=True))
    assert out.columns == corpus_pipeline.COLUMNS and texts(out) == want


def test_mixing_stage_by_row(spark, docs):
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    sizes, got = Counter(), Counter()
    for r in rows_of():
        sizes[r[3]] += len((r[1] or "").split())
    given = {(r[0], r[1]) for r in rows_of()}
    for r in out.collect():
        got[r["source"]] += len(r["text"].split())
        assert any(i == r["doc_id"] and (t or "").startswith(r["text"]) for i, t in given)
    assert all(abs(got[s] - t) <= 1 for s, t in brute_targets(sizes).items())


def test_packing_stage_by_row(spark, docs):
    whole = packing.WordIds(tokenizer_path()).whole
    out = corpus_pipeline.pack(spark, docs, "").collect()
    want = Counter((r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows_of())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n * k for (_, n), k in want.items())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_classifier_on_a_very_long_text(spark):
    text = "word, other words; and 17 more.\n" * 40_000
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = qda.classify(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 2] and all(0 <= r["score"] <= 1 for r in got)
