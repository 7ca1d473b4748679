"""The corpus pipeline: classify, drop near copies, drop repeated passages, mix sources, pack.

Every stage is (spark, docs, sf_dir) -> DataFrame. ``run`` writes each stage's result as Parquet to the shared folder and
reads it again, as the stages' callers do. All stages but the last return the columns of documents: doc_id, text, lang,
source, n_chars.

Results by case: a null text goes through as the empty text would; rows that share an id, or have none, are documents of their
own, and of equal rows near-dedup keeps one; empty tables give empty results; further columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from witloom.llm import mixing, packing, qda, simhash, suffix_dedup
from witloom.llm.common import WORD, spread_join, stored, table
from witloom.llm.queries import tokenizer_path

#: A word with the white space before it.
SPACED = r"[\x20\x09-\x0D]*" + WORD
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant predicts to be good; it learns from the labelled ones among ``docs``."""
    model = qda.fit(qda.training_rows(docs, table(spark, sf_dir, "labels")))
    return qda.with_scores(qda.statistics(docs, *COLUMNS), model).where("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least id, null ids last.

    Near copies are texts whose shingles of five words are alike by 0.8 or more, and those whose fingerprints differ in three
    bits at most; groups are what such links join. Rows are told apart by all their columns, so rows that share an id, or have
    none, but hold different texts all stay. Of equal rows one stays; where many are equal they are dealt out before they meet.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(F.lit(1), "doc_id", "text").alias("k_"), F.xxhash64(F.lit(2), "n_chars", "source", "lang", "text", "doc_id").alias("b_"))
    kept = simhash.representatives(keyed, least=0.8)
    equal = keyed.groupBy("k_", "b_").agg(F.count("*").alias("n"))
    kept = stored(kept.join(equal, ["k_", "b_"]), "kept")
    # The place of a row in its file deals equal rows out; each task then keeps one of them before they meet.
    found = spread_join(keyed.withColumn("at_", F.monotonically_increasing_id()), kept, ["k_", "b_"], ["at_"], sized=True)
    return found.dropDuplicates(["k_", "b_"]).select(*COLUMNS)


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that start at another place as well."""
    cut = suffix_dedup.dedup(docs, keep=["doc_id", "lang", "source"], as_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies; the one that fills a shard's quota is cut behind its last word."""
    docs, at = docs.select(*COLUMNS), F.xxhash64("text", "source", "lang")
    taken = mixing.mix(docs.withColumn("at_", at), keep=["at_"], whole=True)
    same = Window.partitionBy("doc_id", "at_").orderBy("taken")
    taken = taken.withColumn("row_", F.row_number().over(same)).select(F.col("doc_id").alias("id_"), "at_", "row_", "size", "taken")
    rows = docs.withColumn("h_", at)
    rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy("doc_id", "h_").orderBy("n_chars")))
    both = rows.join(stored(taken, "taken"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h_") == F.col("at_")) & (F.col("n_") == F.col("row_")))
    whole, part = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"), F.pmod("taken", F.greatest(F.col("size"), F.lit(1))).cast("int")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED), F.lit(0)), F.lit(1), part), "")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(part > 0, F.array(words)).otherwise(F.array().cast("array<string>")))
    out = both.select("doc_id", F.explode(copies).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_repeats), ("mixing", mix_sources), ("packing", pack)]

#: SQL cannot express the discriminant's scores, the transform or the packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
