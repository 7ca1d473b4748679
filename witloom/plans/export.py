"""The ordered export: normalise, merge groups, drop insignificant columns, binarise, mark gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import columns as C


@dataclass(frozen=True)
class ExportOptions:
    normalise: bool = False
    merge_groups: bool = False
    drop_insignificant: bool = False
    binarise: bool = False
    gaps_significant: bool = False


def export_cells(cells: DataFrame, columns: DataFrame, options: ExportOptions) -> DataFrame:
    if options.normalise:
        cells = C.export_normalised(cells)
    if options.merge_groups:
        cells = C.merge_groups(cells, columns)
        first = F.min("n").alias("n")
        kept = columns.groupBy("passage_id", "group_id", F.when(F.col("group_id").isNull(), F.col("n")).alias("own"))
        columns = kept.agg(first, F.bool_and("insignificant").alias("insignificant"), F.bool_and("binary").alias("binary")).drop("own")
    if options.drop_insignificant:
        cells = C.drop_insignificant(cells, columns)
    if options.binarise:
        cells = C.binarise(cells, columns)
    if options.gaps_significant:
        cells = C.gaps_significant(cells)
    return cells
