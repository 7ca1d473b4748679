"""How often rows move between tasks, and in which form."""

from witloom.operators import columns
from witloom.plans import queries

from .test_packed_tokens import moved


def plan(frame):
    return frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def documents(spark, tmp_path):
    made = [(k, f"Text {'abc' * (k % 5)} number {k}", "en", "s", 9) for k in range(40)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_fasta_lines_move_once(spark, tmp_path):
    lines = queries.fasta_lines(spark, documents(spark, tmp_path))
    assert plan(lines).count(") Exchange\n") == 1
    assert [r["line"][:2] for r in lines.where("passage_id = 1").orderBy("line_no").collect()][:3] == [">W", "te", ">W"]


def test_letter_pairs_are_made_from_counts_in_a_row(spark, tmp_path):
    scores = queries.subst_score(spark, documents(spark, tmp_path))
    assert "x" not in moved(scores) and "regexp_extract_all" not in plan(scores)
    got = {(r["a"], r["b"]): r["cells"] for r in scores.where("passage_id = 1").collect()}
    # "text abc number": the second copy has it as it is, or a letter more.
    assert got["t", "t"] == 4 and got["a", "e"] == 2 and (" ", "a") not in got


def test_columns_given_or_not_merge_alike(spark):
    cells = spark.createDataFrame([("p", s, k, n, f"{s}{n}") for k, s in enumerate("AB") for n in range(4)], "passage_id string, siglum string, wit_ord int, n int, reading string")
    merges = spark.createDataFrame([("p", 2, 1), ("p", 3, 1)], "passage_id string, n int, target int")
    both = [sorted(map(tuple, columns.merge_columns(cells, merges, *known).collect())) for known in ((), (cells.select("passage_id", "n"),))]
    assert both[0] == both[1] == [("p", s, k, n, r) for k, s in enumerate("AB") for n, r in ((0, f"{s}0"), (1, f"{s}1{s}2{s}3"))]
