"""Edits of matrices as tables of edits applied to all passages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import renumber_columns
from .stats import COLUMN, empty_columns, empty_rows


def insert_columns(cells: DataFrame, inserts: DataFrame) -> DataFrame:
    """``inserts`` (passage_id, n, count): gap columns behind column n; further columns of cells move along, null in gaps.

    Each passage's inserts are one small array on its rows, so cells move by a column expression. Passages are dealt over a given number
    of tasks: their bytes, by which Spark would put tasks together, are few beside their rows in memory.
    """
    spark = cells.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    cells = cells.repartition(parts, "passage_id")
    per = inserts.groupBy("passage_id").agg(F.sort_array(F.collect_list(F.struct("n", "count"))).alias("inserts"))
    held = cells.join(per, "passage_id", "left").withColumn("inserts", F.coalesce("inserts", F.array().cast("array<struct<n:int,count:int>>")))
    before = lambda n: F.aggregate(F.filter("inserts", lambda i: i["n"] < n), F.lit(0), lambda a, i: a + i["count"])
    moved = held.withColumn("n", F.col("n") + before(F.col("n"))).select(*cells.columns)
    rows = cells.select("passage_id", "siglum", "wit_ord").distinct().join(per, "passage_id")
    gaps = rows.select("*", F.explode("inserts").alias("i")).select("passage_id", "siglum", "wit_ord", "inserts", "i", F.explode(F.sequence(F.lit(1), F.col("i.count"))).alias("k"))
    gaps = gaps.select("passage_id", "siglum", "wit_ord", (F.col("i.n") + before(F.col("i.n")) + F.col("k")).alias("n"), F.lit("").alias("reading"))
    return moved.unionByName(gaps, allowMissingColumns=True)


def delete_columns(cells: DataFrame, columns: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and columns without the picked columns; groups that these touch dissolve; numbers close up."""
    touched = columns.join(picked, COLUMN, "left_semi").select("passage_id", "group_id").distinct().withColumn("gone", F.lit(True))
    left = columns.join(picked, COLUMN, "left_anti").join(touched, ["passage_id", "group_id"], "left")
    left = left.withColumn("group_id", F.when(F.col("gone").isNull(), F.col("group_id"))).drop("gone")
    return renumber_columns(cells.join(picked, COLUMN, "left_anti")), renumber_columns(left)


def delete_empty_columns(cells: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`delete_columns` for columns of gaps alone, but only groups left with one column or none dissolve."""
    empty = empty_columns(cells)
    left = columns.join(empty, COLUMN, "left_anti")
    size = F.count("*").over(Window.partitionBy("passage_id", "group_id"))
    left = left.withColumn("group_id", F.when(size > 1, F.col("group_id")))
    return renumber_columns(cells.join(empty, COLUMN, "left_anti")), renumber_columns(left)


def set_groups(columns: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (passage_id, low, high, group_id, and optionally ``ord``): columns in a range get its group id; a null id ungroups.

    A sweep: ends of ranges stand among a passage's columns as events, so every column meets its passage's events in one window.
    Where ranges overlap the last edit holds: that of the highest ``ord``, else the one that begins last, then ends first, then has the
    highest id. Further columns of ``columns`` stay.
    """
    rank = [F.col("ord")] if "ord" in ranges.columns else [F.col("low"), -F.col("high"), F.coalesce(F.col("group_id"), F.lit(-1))]
    edits = ranges.where("low <= high").select("passage_id", "low", "high", F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)], F.col("group_id").alias("id")).alias("edit"))
    event = lambda n, opens: edits.select("passage_id", n.cast("long").alias("n"), F.struct("edit", F.lit(opens).alias("opens")).alias("event"))
    events = event(F.col("low"), True).unionByName(event(F.col("high") + 1, False))
    held = columns.select("*", F.struct(*columns.columns).alias("whole_")).select("passage_id", F.col("n").cast("long").alias("n"), "whole_")
    swept = held.unionByName(events, allowMissingColumns=True)
    # Events come before the column of the same place; the ranges open there are those begun less those ended.
    upto = Window.partitionBy("passage_id").orderBy("n", F.col("whole_").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = (F.sort_array(F.collect_list(F.when(F.col("event.opens") == opens, F.col("event.edit"))).over(upto)) for opens in (True, False))
    swept = swept.withColumn("begun_", begun).withColumn("ended_", ended).where("whole_ IS NOT NULL")
    # Equal edits open as often as they begin more than they end.
    times = lambda edits, x: F.size(F.filter(edits, lambda y: y == x))
    open_ = F.filter("begun_", lambda x: times(F.col("begun_"), x) > times(F.col("ended_"), x))
    last = F.try_element_at(open_, F.lit(-1))
    return swept.select(*[(F.when(last.isNotNull(), last["id"]).otherwise(F.col("whole_.group_id")) if c == "group_id" else F.col(f"whole_.{c}")).alias(c) for c in columns.columns])


def set_flags(columns: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (passage_id, n, insignificant, binary): flags that are not null replace the old ones."""
    new = edits.select(*COLUMN, F.col("insignificant").alias("i_"), F.col("binary").alias("b_"))
    return columns.join(new, COLUMN, "left").select(*COLUMN, "group_id", F.coalesce("i_", "insignificant").alias("insignificant"), F.coalesce("b_", "binary").alias("binary"))


def apply_cell_edits(cells: DataFrame, edits: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """``edits`` (passage_id, siglum, n, new_reading): a changed cell loses its lemma; on a reconstructed row it is emended.

    Cells that no edit touches keep all they have, ``emended`` included, and a changed cell on another row keeps it too; further columns
    stay. ``emended`` is false where it was missing.
    """
    new = edits.select("passage_id", "siglum", "n", F.col("new_reading").alias("new_"))
    made = reconstructed.select("siglum").distinct().withColumn("made_", F.lit(True))
    joined = cells.join(new, ["passage_id", "siglum", "n"], "left").join(made, "siglum", "left")
    changed = F.col("new_").isNotNull()
    was = F.coalesce(F.col("emended"), F.lit(False)) if "emended" in cells.columns else F.lit(False)
    fresh = {"reading": F.coalesce("new_", "reading"), "lemma": F.when(~changed, F.col("lemma")), "emended": was | (changed & F.col("made_").isNotNull())}
    return joined.withColumns(fresh).select(*dict.fromkeys([*cells.columns, "emended"]))


def add_row(cells: DataFrame, siglum: str) -> DataFrame:
    """A row of gaps below the last witness of every passage; further columns of cells are null in it."""
    columns = cells.groupBy(*COLUMN).agg(F.max("wit_ord").alias("w"))
    order = F.max("w").over(Window.partitionBy("passage_id")) + 1
    new = columns.select("passage_id", F.lit(siglum).alias("siglum"), order.alias("wit_ord"), "n", F.lit("").alias("reading"))
    return cells.unionByName(new, allowMissingColumns=True)


def delete_rows(cells: DataFrame, named: DataFrame) -> DataFrame:
    """Cells without the witnesses ``named`` (passage_id, siglum); the others keep their order, numbered densely."""
    left = cells.join(named.select("passage_id", "siglum").distinct(), ["passage_id", "siglum"], "left_anti")
    rows = left.select("passage_id", "siglum", "wit_ord").distinct()
    placed = rows.select("passage_id", "siglum", (F.row_number().over(Window.partitionBy("passage_id").orderBy("wit_ord")) - 1).alias("new_ord"))
    return left.join(placed, ["passage_id", "siglum"]).withColumn("wit_ord", F.col("new_ord").cast("int")).select(*cells.columns)


def delete_empty_rows(cells: DataFrame) -> DataFrame:
    return cells.join(empty_rows(cells), ["passage_id", "siglum"], "left_anti")


def move_row(cells: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (passage_id, siglum, after): the witness goes behind the one of order ``after``; -1 makes it the first."""
    rows = cells.select("passage_id", "siglum", "wit_ord").distinct().join(moves, ["passage_id", "siglum"], "left")
    key = F.coalesce(F.col("after") + 0.5, F.col("wit_ord").cast("double"))
    placed = rows.select("passage_id", "siglum", (F.row_number().over(Window.partitionBy("passage_id").orderBy(key, "wit_ord")) - 1).alias("new_ord"))
    return cells.join(placed, ["passage_id", "siglum"]).withColumn("wit_ord", F.col("new_ord").cast("int")).drop("new_ord")
