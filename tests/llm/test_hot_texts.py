"""One text in a third of all rows: its rows are dealt out in op3 and op6, and results stay those of the plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from witloom.llm import license_scan, suffix_dedup
from witloom.llm.common import spread_left_join

COPIES = 10_000


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(2)
    mit = "Permission is hereby granted under the MIT license " + dict(license_scan.TEMPLATES[:1]).popitem()[1] + " and more of these words".join(str(k) for k in range(20))
    texts = ["", None] + [" ".join(rnd.choice(["ab", "cde", "fgh", "ijkl", "m"]) + str(rnd.randrange(10**6)) for _ in range(60)) for _ in range(18)]
    rows = [(k, mit if k % 2 else texts[k // 2 % len(texts)]) for k in range(2 * COPIES)]
    rows = rows[: 2 * COPIES - 1] + [(2 * COPIES, "alone " + " ".join(str(rnd.randrange(10**9)) for _ in range(40)) + mit)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_rows_of_a_hot_key_are_dealt_out(spark, docs):
    """With one key for a third of all rows no part gets more than a few times its share of them."""
    many = docs.select(F.coalesce("text", F.lit("")).alias("key"), F.monotonically_increasing_id().alias("at_"))
    few = many.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 AND key != ''").select("key", F.lit("x").alias("found"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(before, ("-1", "false", "64")):
        spark.conf.set(c, v)
    try:
        joined = spread_left_join(many, few, ["key"], ["at_"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == docs.count() and joined.where("found IS NULL").count() == 1 + joined.where("key = ''").count()
        assert max(sizes) < sum(sizes) / 10
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_license_scan_of_a_hot_text(docs):
    got = license_scan.scan(docs)
    kinds = Counter(tuple(r)[1:] for r in got.join(docs, "doc_id").where("doc_id % 2 = 1").select("doc_id", "labels", "n_base", "first_word", "score").collect())
    assert got.count() == docs.count() and len(kinds) == 1 and sum(kinds.values()) == COPIES - 1 and "mit" in next(iter(kinds))[0]
    assert got.where("doc_id % 20 = 0 AND labels = ''").count() > 0
    one = license_scan.scan(docs.where("doc_id IN (1, 3, 0, 2, 20000)")).collect()
    many = {r["doc_id"]: r for r in got.where("doc_id IN (1, 3, 0, 2, 20000)").collect()}
    assert {r["doc_id"]: r for r in one} == many


def test_suffix_dedup_of_a_hot_text(docs):
    rows = {r["doc_id"]: r for r in suffix_dedup.dedup(docs).collect()}
    assert len(rows) == 2 * COPIES
    for r in docs.collect():
        n, found = len((r["text"] or "").encode()), rows[r["doc_id"]]
        assert found["n_bytes"] == n
        if r["doc_id"] != 2 * COPIES:
            assert (found["n_removed"], found["n_spans"]) == ((n, 1) if n >= 200 else (0, 0))
        else:
            mit = len(docs.where("doc_id = 1").first()["text"].encode())
            assert mit > 200
            assert (found["n_removed"], found["n_spans"]) == (mit, 1)
