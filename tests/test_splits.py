"""Files read in splits give the rows of files read whole, in the order of the file, wherever splits fall."""

import pytest
from pyspark.sql import functions as F

from witloom.sources import readers

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'


@pytest.fixture(params=[700, 1 << 27])
def small_splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1" if request.param == 700 else "4194304"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(frame):
    return sorted(map(repr, frame.collect()))


def tei(i):
    cells = "".join(f'<w n="{k}" lemma="l{k}"> a<hi rend="x">{i}</hi> </w>' for k in range(i % 7))
    return f'<TEI {NS} n="W{i}"><!-- </TEI> --><text><w n="90"/><cl>{cells}</cl><cl><w n="91" emended="true">ś &amp; </w></cl></text></TEI>\n'.replace("<!-- </TEI> -->", "<!-- <TEI> -->" if i % 5 == 0 else "")


def test_fasta_in_splits(spark, small_splits, tmp_path):
    for name, head in (("a", ""), ("b", "; no record\n"), ("empty", ""), ("none", "only words")):
        records = "".join(f">W{i} ā\r\n{'ka' * (i % 90)}\nṛ\n" for i in range(150)) if name in "ab" else ""
        (tmp_path / f"{name}.fas").write_text(head + records, encoding="utf-8", newline="")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.fas").write_text(">A\nx\n>\n\n>A\nx\n", encoding="utf-8")
    for path in (str(tmp_path / "*.fas"), str(tmp_path / "more")):
        assert rows(readers.read_fasta(spark, path)) == rows(readers.parse_fasta(readers.whole_files(spark, path)))
    assert readers.read_fasta(spark, str(tmp_path / "a.fas")).count() == 150
    read = spark.read.option("lineSep", ">").text(str(tmp_path / "a.fas"))
    assert (read.select(F.spark_partition_id()).distinct().count() > 5) == (small_splits == 700)


def test_tei_in_splits(spark, small_splits, tmp_path):
    (tmp_path / "c.xml").write_text(f'<?xml version="1.0"?>\n<teiCorpus {NS}><!-- <TEI n="x"> -->\n' + "".join(map(tei, range(80))) + "</teiCorpus>\n", encoding="utf-8")
    got, wanted = readers.read_tei_matrix(spark, str(tmp_path)), readers.parse_tei_matrix(readers.whole_files(spark, str(tmp_path)))
    assert rows(got) == rows(wanted) and got.select("wit_ord").distinct().count() == 80


def test_malformed_texts_in_splits(spark, small_splits, tmp_path):
    texts = [tei(i) for i in range(9)]
    texts[4] = texts[4].replace("<text>", "<text><p>")
    (tmp_path / "c.xml").write_text(f"<teiCorpus {NS}>" + "".join(texts) + "</teiCorpus>", encoding="utf-8")
    got = {(r["siglum"], r["wit_ord"]) for r in readers.read_tei_matrix(spark, str(tmp_path)).collect()}
    assert got == {(f"W{i}", i) for i in range(9) if i != 4}
    assert [r["path"] for r in readers.rejected(readers.xml_pieces(spark, str(tmp_path), "TEI")).collect()] == ["c"]


def test_trees_in_splits(spark, small_splits, tmp_path):
    def one(t):
        inner = "".join(f'<node id="n{k}" label="W{k}"/><edge id="e{k}" source="n0" target="n{k}" length="0.5"/>' for k in range(1, 4 + t))
        return f'<tree id="t{t}" xsi:type="nex:FloatTree"><node id="n0" root="true"/>{inner}</tree>\n'

    head = '<nex:nexml xmlns:nex="http://www.nexml.org/2009" xmlns="http://www.nexml.org/2009" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><trees otus="o">'
    (tmp_path / "t.xml").write_text(head + "".join(map(one, range(20))) + "</trees></nex:nexml>", encoding="utf-8")
    for got, wanted in zip(readers.read_trees(spark, str(tmp_path)), readers.parse_trees(readers.whole_files(spark, str(tmp_path))), strict=True):
        assert rows(got) == rows(wanted) and got.select("tree_id").distinct().count() == 20
