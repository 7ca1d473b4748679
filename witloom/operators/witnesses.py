"""Sets of witnesses: concatenation of alignments, expansion, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat_alignments(cells: DataFrame) -> DataFrame:
    """Files (work_id, file_ord) of a work end to end: columns of each file follow those before; every witness of the work
    gets every column, gaps where its file lacks it. Witnesses that first appear in a later file keep their readings. Further
    columns of cells (lemma, emended) stay with their readings, null in gaps."""
    more = [c for c in cells.columns if c not in ("work_id", "file_ord", "siglum", "wit_ord", "n", "reading")]
    sizes = cells.groupBy("work_id", "file_ord").agg((F.max("n") + 1).alias("ncols"))
    before = F.sum("ncols").over(Window.partitionBy("work_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("offset", F.coalesce(before, F.lit(0)).cast("int"))
    held = cells.join(offsets, ["work_id", "file_ord"]).select("work_id", "siglum", (F.col("n") + F.col("offset")).alias("n"), "reading", *more)
    order = cells.groupBy("work_id", "siglum").agg(F.min(F.struct("file_ord", "wit_ord")).alias("o"))
    sigla = order.select("work_id", "siglum", (F.row_number().over(Window.partitionBy("work_id").orderBy("o", "siglum")) - 1).alias("wit_ord"))
    columns = offsets.groupBy("work_id").agg(F.sum("ncols").cast("int").alias("total"))
    grid = sigla.join(columns, "work_id").select("work_id", "siglum", "wit_ord", F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("n"))
    return grid.join(held, ["work_id", "siglum", "n"], "left").select("work_id", "siglum", "wit_ord", "n", F.coalesce("reading", F.lit("")).alias("reading"), *more)


def expand_acpc(cells: DataFrame, children: DataFrame) -> DataFrame:
    """Rows of witnesses with children (parent, child), such as before and after correction, once for each child.

    Children stand in their parent's place, by name; witnesses are numbered anew.
    """
    wits = cells.select("passage_id", "siglum", "wit_ord").distinct().join(children, F.col("siglum") == F.col("parent"), "left")
    named = wits.select("passage_id", F.col("siglum").alias("parent"), "wit_ord", F.coalesce("child", "siglum").alias("child"))
    order = Window.partitionBy("passage_id").orderBy("wit_ord", "child")
    placed = named.select("passage_id", "parent", "child", (F.row_number().over(order) - 1).cast("int").alias("new_ord"))
    held = cells.withColumnRenamed("siglum", "parent").join(placed, ["passage_id", "parent"])
    return held.withColumn("siglum", F.col("child")).withColumn("wit_ord", F.col("new_ord")).select(*cells.columns)


def missing_witnesses(cells: DataFrame) -> DataFrame:
    """Sigla of a work that a file of it lacks (to be padded), and whether an earlier file has them."""
    held = cells.select("work_id", "file_ord", "siglum").distinct()
    first = held.groupBy("work_id", "siglum").agg(F.min("file_ord").alias("first_file"))
    files = held.select("work_id", "file_ord").distinct()
    wanted = files.join(first, "work_id")
    return wanted.join(held, ["work_id", "file_ord", "siglum"], "left_anti").select("work_id", "file_ord", "siglum", (F.col("first_file") < F.col("file_ord")).alias("known_before"))


def witnesses_in_tree(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    return cells.join(nodes.where("label IS NOT NULL").select(F.col("label").alias("siglum")), "siglum", "left_semi")
