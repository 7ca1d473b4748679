"""Tables of a collation. A gap is the empty string; a missing lemma is null; ``wit_ord`` is a witness's place in its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITNESS_SEQ = "passage_id string, siglum string, wit_ord int, seq string"
CELLS = "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string, emended boolean"
COLUMNS = "passage_id string, n int, group_id int, insignificant boolean, binary boolean"
TREE_NODE = "tree_id string, node_id string, label string, otu string, is_root boolean"
TREE_EDGE = "tree_id string, edge_id string, edge_ord int, source string, target string, length double"
SUBST = "a string, b string, score double"
SEGMENT = "doc_id string, passage_id string, seg_no int, app_no int, kind string, wits array<string>, text string"


def ragged_rows(cells: DataFrame) -> DataFrame:
    """Witness rows whose columns are not 0 to the passage's last one, each once: empty for a sound matrix."""
    rows = cells.groupBy("passage_id", "siglum").agg(F.count("*").alias("cells"), F.count_distinct("n").alias("columns"), F.max("n").alias("last"))
    last = cells.groupBy("passage_id").agg(F.max("n").alias("of_passage"))
    return rows.join(last, "passage_id").where("cells <> columns OR columns <> of_passage + 1").select("passage_id", "siglum")
