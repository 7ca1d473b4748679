"""What the sinks write is read back: NEXUS, the apparatus and the TEI corpus; broken inputs; further columns of cells."""

import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from witloom.functions import normalise, translit
from witloom.operators import apparatus, edits, witnesses
from witloom.sources import editions, readers, writers

CELLS = "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string, emended boolean"


@pytest.fixture(scope="module")
def cells(spark):
    rows = {"A": ["śiva ", "[]", "b", ""], "B": ["Śiva", "x", "c&d", ""], "C's": ["viṣṇu", "", "b", ""]}
    return spark.createDataFrame([("p", s, k, n, r, "siva" if r == "Śiva" else None, n == 2) for k, (s, rs) in enumerate(rows.items()) for n, r in enumerate(rs)], CELLS)


def test_nexus_gives_the_states_back(cells):
    text = writers.nexus(cells).first()["value"]
    assert re.search(r"NTAX=3;", text) and re.search(r"NCHAR=4;", text) and "TAXLABELS 'A' 'B' 'C''s';" in text
    symbols = re.search(r'SYMBOLS="([^"]*)"', text)[1].split()
    quoted = r"'((?:[^']|'')*)'"
    labels = {}
    for line in text.split("CHARSTATELABELS\n")[1].split("\n;")[0].split(",\n"):
        n, rest = line.split(" / ")
        labels[int(n)] = re.findall(quoted, rest)
    assert labels == {1: ["[]", "ziva", "viSNu"], 2: ["[]", "x"], 3: ["[]", "b", "c&d"], 4: ["[]"]}
    rows = dict(re.findall(rf"^{quoted} (\S+)$", text.split("MATRIX\n")[1], re.M))
    back = {t: ["" if c == "-" else labels[k + 1][symbols.index(c)] for k, c in enumerate(row)] for t, row in rows.items()}
    assert back == {"A": ["ziva", "[]", "b", ""], "B": ["ziva", "x", "c&d", ""], "C''s": ["viSNu", "", "b", ""]}


def test_apparatus_points_to_witnesses(cells):
    base = apparatus.base_witness(cells)
    text = writers.apparatus_tei(cells, base, apparatus.entries(apparatus.base_collation(cells, base))).first()["value"]
    root = ET.fromstring(text.encode())
    tei = "{http://www.tei-c.org/ns/1.0}"
    assert root.get("n") == "A" and [w.get("{http://www.w3.org/XML/1998/namespace}id") for w in root.iter(tei + "witness")] == ["A", "B", "C's"]
    found = [[(e.tag.removeprefix(tei), e.get("wit"), e.text) for e in app] for app in root.iter(tei + "app")]
    assert found == [[("lem", None, "śiva"), ("rdg", "#B", "Śiva"), ("rdg", "#C's", "viṣṇu")], [("lem", None, "[]"), ("rdg", "#B", "x"), ("rdg", "#C's", "[om.]")], [("lem", "#C's", "b"), ("rdg", "#B", "c&d")]]
    normal = apparatus.base_collation(cells.withColumn("lemma", F.when(F.col("siglum") == "A", F.col("reading")).otherwise(F.col("lemma"))), base, normalised=True)
    assert normal.where("n = 2 AND siglum = \"C's\"").first()["agrees"]


def test_corpus_in_iast(spark, cells):
    slp = cells.withColumn("reading", translit.iast_to_slp1(F.col("reading"))).withColumn("lemma", F.lit(None).cast("string"))
    text = writers.tei_matrix(slp, slp1=True).first()["value"]
    assert text.startswith("<?xml") and ET.fromstring(text.encode()).tag == "{http://www.tei-c.org/ns/1.0}teiCorpus"
    back = readers.parse_tei_matrix(spark.createDataFrame([("p", text)], "path string, value string"))
    assert [r["reading"] for r in back.where("n = 0").orderBy("wit_ord").collect()] == ["śiva ", "Śiva", "viṣṇu"]


def test_broken_files_have_no_rows(spark):
    files = spark.createDataFrame([("good", '<nexml><tree id="t"><node id="a"/><!-- c --><edge id="e" source="a" target="b"/></tree></nexml>'), ("cut", "<nexml><tree"), ("none", None)], "path string, value string")
    nodes, edges = readers.parse_trees(files)
    assert nodes.count() == edges.count() == 1
    assert readers.parse_tei_matrix(files).count() == 0 and editions.segments(files).count() == 0
    assert {r["path"] for r in readers.rejected(files).collect()} == {"cut", "none"}


def test_csv_field_with_a_line_break(spark):
    files = spark.createDataFrame([("p", 'A,"a\nb","c""d"\r\nB,x,\n\nC,"",y')], "path string, value string")
    got = [(r["siglum"], r["wit_ord"], r["n"], r["reading"]) for r in readers.parse_alignment_csv(files).orderBy("wit_ord", "n").collect()]
    assert got == [("A", 0, 0, "a\nb"), ("A", 0, 1, 'c"d'), ("B", 1, 0, "x"), ("C", 3, 0, ""), ("C", 3, 1, "y")]


def test_further_columns_stay(spark, cells):
    assert set(edits.add_row(cells, "N").columns) == set(edits.insert_columns(cells, spark.createDataFrame([("p", 1, 1)], "passage_id string, n int, count int")).columns) == set(cells.columns)
    assert edits.add_row(cells, "N").where("lemma = 'siva'").count() == 1
    work = cells.withColumn("work_id", F.lit("w")).withColumn("file_ord", F.lit(0))
    joined = witnesses.concat_alignments(work.unionByName(work.withColumn("file_ord", F.lit(1))))
    assert sorted(r["n"] for r in joined.where("lemma = 'siva'").collect()) == [0, 4] and joined.where("emended").count() == 6
    twice = witnesses.expand_acpc(cells, spark.createDataFrame([("B", "Bac"), ("B", "Bpc")], "parent string, child string"))
    assert sorted({(r["wit_ord"], r["siglum"]) for r in twice.collect()}) == [(0, "A"), (1, "Bac"), (2, "Bpc"), (3, "C's")] and twice.where("lemma = 'siva'").count() == 2
    left = edits.delete_rows(cells, spark.createDataFrame([("p", "B")], "passage_id string, siglum string"))
    assert sorted({(r["wit_ord"], r["siglum"]) for r in left.collect()}) == [(0, "A"), (1, "C's")]


def test_aksara_tokens_keep_the_text(spark):
    texts = ["tac ca tattvaM nityam || 1 ||", "ātmā vastu svabhāvaś ca", "", "om̐ aîkya", "  kṣetre"]
    wits = spark.createDataFrame([("p", f"W{i}", i, t) for i, t in enumerate(texts)], "passage_id string, siglum string, wit_ord int, seq string")
    plain = wits.select("siglum", translit.iast_to_slp1(F.col("seq")).alias("slp"), translit.split_aksaras(normalise.normalise_text(translit.iast_to_slp1(F.col("seq")), spaces=normalise.REMOVE_SPACES)).alias("units"))
    for r in normalise.normalise_tokens(wits, "aksara").join(plain, "siglum").collect():
        assert "".join(t["surface"] for t in r["toks"]) == r["slp"]
        assert [t["norm"] for t in r["toks"] if t["norm"]] == r["units"]


def test_replacements_match_glyph_by_glyph(spark):
    import random

    rnd = random.Random(1)
    letters = [*translit.all_glyphs(translit.IAST), *translit.HK_FROM, " ", "'", "x", "", ""]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for pairs in (translit.IAST_TO_SLP1, translit.SLP1_TO_IAST, dict(zip(translit.HK_FROM, translit.HK_TO, strict=True))):
        glyph = re.compile(f"(?s){translit.alternatives(list(pairs))}|.")
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r["i"]: r["v"] for r in frame.select("i", translit.replace_glyphs(F.col("t"), pairs).alias("v")).collect()}
        assert got == {i: "".join(pairs.get(g, g) for g in glyph.findall(t)) for i, t in enumerate(texts)}
