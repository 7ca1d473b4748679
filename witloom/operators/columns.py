"""Reshaping columns: readings, merging, grouping, flags, renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import COLUMN

ROW = ["passage_id", "siglum", "wit_ord"]


def ordered_join(value: str | Column, separator: str = "") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", value.alias("v")))), lambda x: x["v"]), separator)


def pick_reading(cells: DataFrame) -> DataFrame:
    """The normalised view: the lemma where there is one."""
    return cells.withColumn("picked", F.coalesce("lemma", "reading"))


def span_reading(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Cells ``low`` to ``high`` of each row as one reading: joined by spaces, white space collapsed."""
    joined = cells.where(F.col("n").between(low, high)).groupBy(*ROW).agg(ordered_join("reading", " ").alias("joined"))
    return joined.select(*ROW, F.trim(F.regexp_replace("joined", r"\s+", " ")).alias("reading"))


def drop_insignificant(cells: DataFrame, columns: DataFrame) -> DataFrame:
    return cells.join(columns.where("insignificant").select(*COLUMN), COLUMN, "left_anti")


def gaps_significant(cells: DataFrame) -> DataFrame:
    return cells.withColumn("reading", F.when(F.col("reading") == "", "[]").otherwise(F.col("reading")))


def export_normalised(cells: DataFrame) -> DataFrame:
    return cells.withColumn("reading", F.coalesce("lemma", "reading"))


def renumber_columns(cells: DataFrame) -> DataFrame:
    """Columns numbered densely from 0. Ranks are taken on the column table, a k-th of the cells."""
    columns = cells.select(*COLUMN).distinct().withColumn("new_n", F.row_number().over(Window.partitionBy("passage_id").orderBy("n")) - 1)
    return cells.join(columns, COLUMN).withColumn("n", F.col("new_n").cast("int")).drop("new_n")


def merge_columns(cells: DataFrame, merges: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Columns named in ``merges`` (passage_id, n, target) become their target: readings join in column order, lemmas go.

    New numbers are worked out on the column table, so cells move to it and to their rows only. ``columns``: that table (all of
    the cells' columns and no others), if there is one; else it is made from the cells.
    """
    known = (cells if columns is None else columns).select(*COLUMN).distinct()
    moved = known.join(merges.select(*COLUMN, "target"), COLUMN, "left")
    placed = F.dense_rank().over(Window.partitionBy("passage_id").orderBy(F.coalesce("target", "n"))) - 1
    numbered = moved.select(*COLUMN, placed.cast("int").alias("new_n"))
    merged = cells.join(numbered, COLUMN).groupBy(*ROW, "new_n").agg(ordered_join("reading").alias("reading"))
    return merged.select(*ROW, F.col("new_n").alias("n"), "reading")


def merge_groups(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Each group becomes its first column: readings join, and so do lemmas or else readings; a lemma equal to the text goes."""
    grouped = cells.join(columns.select(*COLUMN, "group_id"), COLUMN, "left").withColumn("own", F.when(F.col("group_id").isNull(), F.col("n")))
    norm = F.coalesce(F.nullif(F.col("lemma"), F.lit("")), F.col("reading"))
    merged = grouped.groupBy(*ROW, "group_id", "own").agg(F.min("n").alias("n"), ordered_join("reading").alias("reading"), ordered_join(norm).alias("norm"))
    return merged.select(*ROW, "n", "reading", F.when(F.col("norm") != F.col("reading"), F.col("norm")).alias("lemma"))


def binarise(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """In flagged columns every non-gap becomes ``[first non-gap]``, first in witness order."""
    flagged = columns.where("binary").select(*COLUMN)
    first = cells.where("reading <> ''").join(flagged, COLUMN, "left_semi").groupBy(*COLUMN).agg(F.min_by("reading", "wit_ord").alias("state"))
    marked = cells.join(first, COLUMN, "left")
    return marked.withColumn("reading", F.when((F.col("reading") != "") & F.col("state").isNotNull(), F.concat(F.lit("["), "state", F.lit("]"))).otherwise(F.col("reading"))).drop("state")


def group_by_whitespace(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """New groups of ungrouped columns that end at columns where half the non-empty rows or more end in a space.

    Columns already grouped end a run and stay as they are; runs of one column are no group. Group ids are the first
    column's number.
    """
    ratio = cells.where("reading <> ''").groupBy(*COLUMN).agg(F.avg(F.endswith("reading", F.lit(" ")).cast("double")).alias("ratio"))
    at = Window.partitionBy("passage_id").orderBy("n")
    last = F.lead("n").over(at).isNull()
    marked = columns.select(*COLUMN, "group_id").join(ratio, COLUMN, "left").withColumn("ends", F.coalesce(F.col("ratio") >= 0.5, F.lit(False)) | last | F.col("group_id").isNotNull())
    run = F.coalesce(F.sum(F.col("ends").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = marked.withColumn("run", run)
    whole = Window.partitionBy("passage_id", "run")
    free = F.count(F.when(F.col("group_id").isNull(), 1)).over(whole)
    first = F.min(F.when(F.col("group_id").isNull(), F.col("n"))).over(whole)
    return runs.select(*COLUMN, F.when(F.col("group_id").isNotNull(), F.col("group_id")).when(free >= 2, first).alias("group_id"))


def group_position(columns: DataFrame) -> DataFrame:
    """Where a column stands in its group: start, internal or end."""
    group = Window.partitionBy("passage_id", "group_id")
    place, size = F.row_number().over(group.orderBy("n")), F.count("*").over(group)
    return columns.where("group_id IS NOT NULL").select(*COLUMN, "group_id", F.when(place == 1, "start").when(place == size, "end").otherwise("internal").alias("position"))


def nearest_nonempty(cells: DataFrame) -> DataFrame:
    """Column of the nearest reading at or before, and at or after, each cell of a row."""
    row = Window.partitionBy("passage_id", "siglum").orderBy("n")
    held = F.when(F.col("reading") != "", F.col("n"))
    before = F.last(held, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(held, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    return cells.select("passage_id", "siglum", "n", before.alias("before"), after.alias("after"))
