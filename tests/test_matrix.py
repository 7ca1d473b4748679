"""Matrix operators on literal tables."""

import pytest
from pyspark.sql import functions as F

from witloom.operators import apparatus, coding, columns, edits, stats, witnesses

CELLS = "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string"


@pytest.fixture(scope="module")
def m1(spark):
    """Three witnesses, four columns: a gap, a column of gaps, a row of gaps, two variants in one column."""
    rows = {"A": ["a ", "", "b", "x"], "B": ["a", "", "c", "X"], "C": ["", "", "", ""]}
    data = [("p", s, k, n, r, "x" if r == "X" else None) for k, (s, rs) in enumerate(rows.items()) for n, r in enumerate(rs)]
    return spark.createDataFrame(data, CELLS)


def columns_of(spark, groups, insignificant=(), binary=()):
    return spark.createDataFrame([("p", n, g, n in insignificant, n in binary) for n, g in enumerate(groups)], "passage_id string, n int, group_id int, insignificant boolean, binary boolean")


def rows(frame, *names):
    return sorted(tuple(r) for r in frame.select(*names).collect())


def test_counts(m1):
    assert rows(stats.column_stats(m1), "n", "label") == [(0, "2(2)"), (1, "0"), (2, "2(2)"), (3, "2(2)")]
    assert rows(stats.empty_columns(m1), "n") == [(1,)]
    assert rows(stats.empty_rows(m1), "siglum") == [("C",)]
    assert rows(stats.matrix_dims(m1), "ntax", "nchar", "maxlemma") == [(3, 4, 3)]
    assert (2, "", "C") in rows(stats.variant_groups(m1), "n", "reading", "sigla")
    assert rows(stats.column_bounds(m1.where("n = 2").select("passage_id", "n").distinct()), "low", "high") == [(2, None)]


def test_apparatus(m1):
    base = apparatus.base_witness(m1)
    entries = apparatus.apparatus(apparatus.base_collation(m1, base))
    assert rows(entries, "n", "lemma", "spaced", "positive", "negative") == [(0, "a", True, "", "a B; [om.] C"), (2, "b", False, "", "c B; [om.] C"), (3, "x", False, "", "X B; [om.] C")]
    normal = apparatus.apparatus(apparatus.base_collation(m1, base, normalised=True))
    assert (3, "x", "B", "[om.] C") in rows(normal, "n", "lemma", "positive", "negative")


def test_states(spark, m1):
    marked = m1.withColumn("reading", F.when((F.col("n") == 1) & (F.col("siglum") == "B"), "[]").otherwise(F.col("reading")))
    states = coding.nexus_states(marked)
    assert rows(states.where("n = 2"), "siglum", "symbol") == [("A", "1"), ("B", "2"), ("C", "-")]
    assert rows(coding.nexus_labels(marked), "n", "labels") == [(0, "a  a"), (1, "[]"), (2, "b c"), (3, "x X")]
    many = spark.createDataFrame([("p", f"W{i}", i, 0, f"r{i:02}", None) for i in range(57)], CELLS)
    found = dict(rows(coding.nexus_states(many), "wit_ord", "symbol"))
    assert len(coding.SYMBOLS) == 55 and found[0] == "1" and found[54] == "z" and found[55] == found[56] == "?"


@pytest.mark.parametrize("text,want", [("0" * 8, "-" * 8), ("1" + "0" * 7 + "2", "1" + "0" * 7 + "2"), ("00100000000001", "001----------1"), ("", None)])
def test_runs(spark, text, want):
    states = spark.createDataFrame([("p", "A", 0, n, c) for n, c in enumerate(text)], "passage_id string, siglum string, wit_ord int, n int, symbol string")
    got = [r["states"] for r in coding.nexus_rows(states).collect()]
    assert got == ([want] if want is not None else [])
    masked = coding.mask_runs(states).orderBy("n").collect()
    assert "".join(r["symbol"] for r in masked) == (want or "")


def test_columns(spark, m1):
    cols = columns_of(spark, [0, 0, None, 3], insignificant=(3,), binary=(2,))
    merged = columns.merge_groups(m1, cols)
    assert rows(merged.where("siglum = 'B'"), "n", "reading", "lemma") == [(0, "a", None), (2, "c", None), (3, "X", "x")]
    assert rows(columns.drop_insignificant(m1, cols), "n") == [(n,) for n in (0, 0, 0, 1, 1, 1, 2, 2, 2)]
    assert rows(columns.binarise(m1, cols).where("n = 2"), "reading") == [("",), ("[b]",), ("[b]",)]
    assert rows(columns.span_reading(m1, 0, 3), "siglum", "reading") == [("A", "a b x"), ("B", "a c X"), ("C", "")]
    merges = spark.createDataFrame([("p", 1, 0), ("p", 2, 0)], "passage_id string, n int, target int")
    assert rows(columns.merge_columns(m1, merges).where("siglum = 'A'"), "n", "reading") == [(0, "a b"), (1, "x")]
    near = columns.nearest_nonempty(m1).where("siglum = 'A'")
    assert rows(near, "n", "before", "after") == [(0, 0, 0), (1, 0, 2), (2, 2, 2), (3, 3, 3)]
    assert rows(columns.group_position(columns_of(spark, [1, 1, 1, None])), "n", "position") == [(0, "start"), (1, "internal"), (2, "end")]


def test_grouping_by_whitespace(spark):
    # Exactly half of the readings end in a space in column 1; column 3 is grouped already; 4 and 5 end the text.
    readings = {"A": ["a", "b ", "c", "d", "e", "f"], "B": ["a", "b", "c", "d", "e", "f"]}
    cells = spark.createDataFrame([("p", s, k, n, r, None) for k, (s, rs) in enumerate(readings.items()) for n, r in enumerate(rs)], CELLS)
    got = rows(columns.group_by_whitespace(cells, columns_of(spark, [None, None, None, 9, None, None])), "n", "group_id")
    assert got == [(0, 0), (1, 0), (2, None), (3, 9), (4, 4), (5, 4)]


def test_edits(spark, m1):
    inserts = spark.createDataFrame([("p", 0, 2), ("p", 3, 1)], "passage_id string, n int, count int")
    longer = edits.insert_columns(m1.drop("lemma"), inserts)
    assert rows(longer.where("siglum = 'B'"), "n", "reading") == [(0, "a"), (1, ""), (2, ""), (3, ""), (4, "c"), (5, "X"), (6, "")]
    back, _ = edits.delete_columns(longer, columns_of(spark, [None] * 7), spark.createDataFrame([("p", n) for n in (1, 2, 6)], "passage_id string, n int"))
    assert rows(back, "siglum", "n", "reading") == rows(m1, "siglum", "n", "reading")
    cells, cols = edits.delete_empty_columns(m1, columns_of(spark, [7, 7, 7, 8]))
    assert rows(cells, "n") == [(n,) for n in (0, 0, 0, 1, 1, 1, 2, 2, 2)] and rows(cols, "n", "group_id") == [(0, 7), (1, 7), (2, None)]
    ranges = spark.createDataFrame([("p", 1, 2, 5)], "passage_id string, low int, high int, group_id int")
    grouped = edits.set_groups(columns_of(spark, [None] * 4), ranges)
    assert rows(grouped.where("group_id = 5"), "n") == [(1,), (2,)]
    undone = edits.set_groups(grouped, ranges.withColumn("group_id", F.lit(None).cast("int")))
    assert undone.where("group_id IS NOT NULL").count() == 0
    change = spark.createDataFrame([("p", "B", 3, "new")], "passage_id string, siglum string, n int, new_reading string")
    done = edits.apply_cell_edits(m1, change, spark.createDataFrame([("B",)], "siglum string"))
    assert rows(done.where("n = 3"), "siglum", "reading", "emended") == [("A", "x", False), ("B", "new", True), ("C", "", False)]
    assert edits.delete_empty_rows(edits.add_row(m1.drop("lemma"), "N")).select("siglum").distinct().count() == 2
    moved = edits.move_row(m1, spark.createDataFrame([("p", "C", -1)], "passage_id string, siglum string, after int"))
    assert rows(moved.where("n = 0"), "wit_ord", "siglum") == [(0, "C"), (1, "A"), (2, "B")]


def test_concatenation(spark):
    data = [("w", 0, "A", 0, 0, "a"), ("w", 0, "A", 0, 1, "b"), ("w", 1, "A", 0, 0, "c"), ("w", 1, "B", 1, 0, "d")]
    cells = spark.createDataFrame(data, "work_id string, file_ord int, siglum string, wit_ord int, n int, reading string")
    assert rows(witnesses.concat_alignments(cells), "siglum", "n", "reading") == [("A", 0, "a"), ("A", 1, "b"), ("A", 2, "c"), ("B", 0, ""), ("B", 1, ""), ("B", 2, "d")]
    assert rows(witnesses.missing_witnesses(cells), "file_ord", "siglum", "known_before") == [(0, "B", False)]
