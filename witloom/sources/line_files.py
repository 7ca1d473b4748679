"""Sinks line by line: a passage's file is many rows, written by many tasks.

Each ``*_lines`` gives passage_id, part, at, line; a file is its lines by (part, at). Lines are those of the texts that
:mod:`witloom.sources.writers` makes, so no passage has to be one string: the longest row is one witness (or, in NEXUS, all
sigla, or one column's labels). An empty matrix gives no lines. The apparatus stays with the writers: its text is one paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.translit import slp1_to_iast
from ..operators.coding import SYMBOLS, coded_readings, column_states, file_labels, nexus_rows, nexus_states
from ..operators.columns import ordered_join
from ..storage import stored
from .writers import ROW, TEI, XML_HEAD, by_witness, csv_cell, tei_text, tei_word

LINES = ["passage_id", "part", "at", "line"]


def _rows(rows: DataFrame, part: int, at: str | Column, line: str | Column) -> DataFrame:
    place, text = (F.col(c) if isinstance(c, str) else c for c in (at, line))
    return rows.select("passage_id", F.lit(part).alias("part"), place.cast("long").alias("at"), text.alias("line"))


def _around(passages: DataFrame, part: int, *lines: str | Column) -> DataFrame:
    """The same lines for every row of ``passages``."""
    shown = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return _rows(passages.select("*", F.posexplode(shown).alias("at_", "line_")), part, "at_", "line_")


def tei_matrix_lines(cells: DataFrame, slp1: bool = False) -> DataFrame:
    """The TEI corpus: a line a witness."""
    if slp1:
        cells = cells.withColumns({c: slp1_to_iast(F.col(c)) for c in ("reading", "lemma")})
    rows = cells.groupBy(*ROW).agg(ordered_join(tei_word()).alias("ws"))
    passages = cells.select("passage_id").distinct()
    head = _around(passages, 0, XML_HEAD.rstrip("\n"), f'<teiCorpus xmlns="{TEI}">')
    return head.unionByName(_rows(rows, 1, "wit_ord", tei_text("ws"))).unionByName(_around(passages, 2, "</teiCorpus>"))


def alignment_csv_lines(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy(*ROW).agg(ordered_join(csv_cell(), ",").alias("cells"))
    return _rows(rows, 0, "wit_ord", F.concat_ws(",", "siglum", "cells"))


def fasta_lines(witnesses: DataFrame) -> DataFrame:
    return _rows(witnesses.withColumn("own", F.array(F.concat(F.lit(">"), "siglum"), F.col("seq"))).select("*", F.posexplode("own").alias("k", "line")), 0, F.col("wit_ord") * 2 + F.col("k"), "line")


def nexus_lines(cells: DataFrame) -> DataFrame:
    """Readings are coded first. State labels are a line a column, the matrix a line a witness."""
    cells = stored(coded_readings(cells), "coded")
    states = stored(column_states(cells), "states")
    quoted = F.concat(F.lit("'"), F.replace("siglum", F.lit("'"), F.lit("''")), F.lit("'"))
    rows = stored(nexus_rows(nexus_states(cells, states)).withColumn("taxon", quoted), "rows")
    taxa = rows.groupBy("passage_id").agg(F.count("*").alias("ntax"), F.max(F.length("states")).alias("nchar"), by_witness("taxon", " ").alias("taxa"))
    symbols = " ".join("0" + SYMBOLS)
    head = _around(
        taxa, 0, "#NEXUS", "", "BEGIN TAXA;", F.concat(F.lit("  DIMENSIONS NTAX="), F.col("ntax").cast("string"), F.lit(";")), F.concat(F.lit("  TAXLABELS "), "taxa", F.lit(";")), "END;", "",
        "BEGIN CHARACTERS;", F.concat(F.lit("  DIMENSIONS NCHAR="), F.col("nchar").cast("string"), F.lit(";")), f'  FORMAT DATATYPE=STANDARD RESPECTCASE GAP=- MISSING=? SYMBOLS="{symbols}";', "  CHARSTATELABELS",
    )
    last = states.groupBy("passage_id").agg(F.max("n").alias("last"))
    comma = F.when(F.col("n") < F.col("last"), ",").otherwise("")
    labels = file_labels(cells, states).join(last, "passage_id")
    labels = _rows(labels, 1, "n", F.concat((F.col("n") + 1).cast("string"), F.lit(" / "), "labels", comma))
    matrix = _rows(rows, 3, "wit_ord", F.concat("taxon", F.lit(" "), "states"))
    passages = taxa.select("passage_id")
    parts = (labels, _around(passages, 2, ";", "MATRIX"), matrix, _around(passages, 4, ";", "END;", ""))
    for part in parts:
        head = head.unionByName(part)
    return head


def numbered(lines: DataFrame) -> DataFrame:
    """passage_id, line_no (from 1 in each file), line."""
    place = F.row_number().over(Window.partitionBy("passage_id").orderBy("part", "at"))
    return lines.select("passage_id", place.alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str, ending: str) -> None:
    """A folder a passage, ``passage=<id>.<ending>``; its part files, by name, are the file in order.

    Lines are dealt by ranges of their place, so a passage of many lines is several tasks and part files and small ones share a
    task. The folder's name leads the order of the rows, as writing by folders needs it sorted: no later sort can turn lines round.
    """
    folder = F.concat(F.coalesce(F.col("passage_id").cast("string"), F.lit("")), F.lit(f".{ending}")).alias("passage")
    placed = lines.select(folder, "part", "at", F.coalesce("line", F.lit("")).alias("value"))
    ordered = placed.repartitionByRange("passage", "part", "at").sortWithinPartitions("passage", "part", "at")
    ordered.select("value", "passage").write.partitionBy("passage").text(path)
