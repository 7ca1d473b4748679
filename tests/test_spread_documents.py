from pyspark.sql import functions as F

from witloom.plans import derived


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """A file of one row group is read by one task; texts must be worked on by many."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("tasmāt x "), F.col("id").cast("string")).alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for made in (derived.witness_seq, derived.words_text, derived.witness_copies):
        rows = made(spark, str(tmp_path))
        counts = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(counts) > 8 and max(counts) < sum(counts) / 4
