"""Discrete character states for phylogenetics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.translit import nexus_reading
from .stats import COLUMN

#: Symbols of the states after 0, without I, J, O and their small letters.
SYMBOLS = "123456789ABCDEFGHKLMNPQRSTUVWXYZabcdefghklmnpqrstuvwxyz"
OVERFLOW = "?"


def coded_readings(cells: DataFrame) -> DataFrame:
    """Readings as states are named in files: trimmed, lower case, Harvard-Kyoto; what differs in spelling of these alone is one state."""
    return cells.withColumn("reading", nexus_reading(F.col("reading")))


def state_numbers(cells: DataFrame) -> DataFrame:
    """Distinct readings of a column by first appearance in witness order, from 1; gaps and ``[]`` have no number."""
    first = cells.where(~F.col("reading").isin("", "[]")).groupBy(*COLUMN, "reading").agg(F.min("wit_ord").alias("first"))
    return first.withColumn("state", F.row_number().over(Window.partitionBy(*COLUMN).orderBy("first", "reading"))).drop("first")


def symbol_of(state: Column, reading: Column) -> Column:
    """Readings past the last symbol are written ``?``: the row keeps its length."""
    return F.when(reading == "", "-").when(reading == "[]", "0").when(state > len(SYMBOLS), OVERFLOW).otherwise(F.substring(F.lit(SYMBOLS), state, F.lit(1)))


def column_states(cells: DataFrame) -> DataFrame:
    """passage_id, n, states: every column's readings in the order of their numbers (as :func:`state_numbers` gives them)."""
    first = cells.groupBy(*COLUMN, "reading").agg(F.min("wit_ord").alias("first"))
    held = F.collect_list(F.when(~F.col("reading").isin("", "[]"), F.struct("first", "reading")))
    return first.groupBy(*COLUMN).agg(F.transform(F.sort_array(held), lambda x: x["reading"]).alias("states"))


def nexus_states(cells: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """A symbol a cell; ``states``: the columns' states, if they are made already. Only those that have a symbol are sought."""
    known = (column_states(cells) if states is None else states).select(*COLUMN, F.slice("states", 1, len(SYMBOLS)).alias("states"))
    at = F.array_position("states", F.col("reading")).cast("int")
    state = F.when(at == 0, len(SYMBOLS) + 1).otherwise(at)
    return cells.join(known, COLUMN, "left").select("passage_id", "siglum", "wit_ord", "n", symbol_of(state, F.col("reading")).alias("symbol"))


def nexus_labels(cells: DataFrame) -> DataFrame:
    """State labels of each column in the order of their symbols; ``[]`` comes first where it occurs."""
    numbered = state_numbers(cells).unionByName(cells.where("reading = '[]'").select(*COLUMN, "reading").distinct().withColumn("state", F.lit(0)))
    return numbered.groupBy(*COLUMN).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("state", "reading"))), lambda x: x["reading"]), " ").alias("labels"))


def file_labels(cells: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Quoted state labels of every column as a file lists them: ``[]``, the label of symbol 0, always first."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    shown = F.array_join(F.concat(F.array(F.lit("'[]'")), F.transform("states", quoted)), " ").alias("labels")
    return (column_states(cells) if states is None else states).select(*COLUMN, shown)


def mask_runs(states: DataFrame, least: int = 8) -> DataFrame:
    """Runs of ``least`` or more ``0`` in a row become ``-``: the island of a cell is its place in the row less its rank among equals."""
    island = F.row_number().over(Window.partitionBy("passage_id", "siglum").orderBy("n")) - F.row_number().over(Window.partitionBy("passage_id", "siglum", "symbol").orderBy("n"))
    marked = states.withColumn("island", island)
    size = F.count("*").over(Window.partitionBy("passage_id", "siglum", "symbol", "island"))
    return marked.withColumn("symbol", F.when((F.col("symbol") == "0") & (size >= least), "-").otherwise(F.col("symbol"))).drop("island")


def nexus_rows(states: DataFrame, least: int = 8) -> DataFrame:
    """The row string of each witness, long runs of ``0`` masked. Row strings are put together first: the mask is a replacement."""
    rows = states.groupBy("passage_id", "siglum", "wit_ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "symbol"))), lambda x: x["symbol"]), "").alias("states"))
    runs = F.regexp_extract_all("states", F.lit("0+|[^0]+"), F.lit(0))
    masked = F.array_join(F.transform(runs, lambda r: F.when(r.startswith("0") & (F.length(r) >= least), F.repeat(F.lit("-"), F.length(r))).otherwise(r)), "")
    return rows.select("passage_id", "siglum", "wit_ord", masked.alias("states"))
