"""Counts and groups over the columns and rows of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = ["passage_id", "n"]


def is_reading() -> Column:
    return F.col("reading") != ""


def column_stats(cells: DataFrame) -> DataFrame:
    """Non-gap and distinct non-gap readings of each column; the label shows the distinct ones from two readings on.

    Readings are counted per (column, reading) first, so a column's frequent reading is one row before it is shuffled.
    """
    kinds = cells.groupBy(*COLUMN, "reading").agg(F.count("*").alias("c"))
    per = kinds.groupBy(*COLUMN).agg(F.coalesce(F.sum(F.when(is_reading(), F.col("c"))), F.lit(0)).alias("readings"), F.count(F.when(is_reading(), 1)).alias("kinds"))
    label = F.when(F.col("readings") < 2, F.col("readings").cast("string")).otherwise(F.format_string("%d(%d)", "readings", "kinds"))
    return per.select(*COLUMN, "readings", "kinds", label.alias("label"))


def empty_columns(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*COLUMN).agg(F.bool_or(is_reading()).alias("any")).where("NOT any").select(*COLUMN)


def empty_rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("passage_id", "siglum").agg(F.bool_or(is_reading()).alias("any")).where("NOT any").select("passage_id", "siglum")


def ordered_sigla() -> Column:
    """Sigla of a group in witness order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wit_ord", "siglum"))), lambda x: x["siglum"]), " ")


def variant_groups(cells: DataFrame) -> DataFrame:
    """Witnesses by reading in each column; a gap is a class of its own."""
    return cells.groupBy(*COLUMN, "reading").agg(F.count("*").alias("size"), ordered_sigla().alias("sigla"))


def matrix_dims(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy("passage_id", "siglum").agg(F.max("n").alias("last"), F.count("*").alias("c"))
    return rows.groupBy("passage_id").agg(F.count("*").alias("ntax"), F.max("c").alias("nchar"), F.max("last").alias("maxlemma"))


def column_bounds(picked: DataFrame) -> DataFrame:
    """Lowest and highest column of a set; no highest for a single one."""
    return picked.groupBy("passage_id").agg(F.min("n").alias("low"), F.when(F.count("*") > 1, F.max("n")).alias("high"))


def flag_state(columns: DataFrame, picked: DataFrame) -> DataFrame:
    """Whether all picked columns of a passage bear each flag."""
    return columns.join(picked, COLUMN, "left_semi").groupBy("passage_id").agg(F.bool_and("insignificant").alias("insignificant"), F.bool_and("binary").alias("binary"))


def dissolving_groups(columns: DataFrame, picked: DataFrame, threshold: int = 1) -> DataFrame:
    """Groups that the picked columns touch, and whether they dissolve: at most ``threshold`` members are left."""
    marked = columns.where("group_id IS NOT NULL").join(picked.select(*COLUMN).distinct().withColumn("hit", F.lit(True)), COLUMN, "left")
    groups = marked.groupBy("passage_id", "group_id").agg(F.count("hit").alias("touched"), F.count_if(F.col("hit").isNull()).alias("left_over"))
    return groups.where("touched > 0").select("passage_id", "group_id", "touched", "left_over", (F.col("left_over") <= threshold).alias("dissolves"))
