from pyspark.sql import functions as F

from witloom.operators import edits


def test_passages_stay_dealt_over_tasks(spark):
    """Small bytes don't bring all passages into one task, whose memory would grow with the table; cells and gaps are those of each passage."""
    ids = spark.range(300).select(F.col("id").alias("passage_id"))
    cells = ids.crossJoin(spark.createDataFrame([("A", 0, 0, "x"), ("A", 0, 1, "y"), ("B", 1, 0, "z")], "siglum string, wit_ord int, n int, reading string"))
    inserts = ids.where("passage_id % 3 = 0").select("passage_id", F.lit(0).alias("n"), F.lit(2).alias("count"))
    made = edits.insert_columns(cells, inserts)
    held = made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(held) > 8 and max(r["n"] for r in held) < sum(r["n"] for r in held) / 4
    rows = {}
    for r in made.collect():
        rows.setdefault(r["passage_id"], []).append((r["siglum"], r["n"], r["reading"]))
    with_gaps = [("A", 0, "x"), ("A", 1, ""), ("A", 2, ""), ("A", 3, "y"), ("B", 0, "z"), ("B", 1, ""), ("B", 2, "")]
    assert all(sorted(rows[p]) == (with_gaps if p % 3 == 0 else [("A", 0, "x"), ("A", 1, "y"), ("B", 0, "z")]) for p in range(300))
