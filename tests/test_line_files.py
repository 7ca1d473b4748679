"""Files written line by line hold the texts of the writers, whatever the number of tasks that write a passage."""

import os
import random

import pytest
from pyspark.sql import functions as F

from witloom.sources import line_files, writers

CELLS = "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string"


@pytest.fixture(scope="module")
def cells(spark):
    rnd = random.Random(3)
    words = ["śiva ", "[]", "", 'a"b', "c&d <e>", "x,y", "viṣṇu"]
    rows = []
    for p, witnesses, width in (("one", 1, 1), ("p/2", 3, 5), ("long", 60, 40), ("long é", 7, 12)):
        order = rnd.sample(range(100), witnesses)
        rows += [(p, f"W'{w}", w, n, rnd.choice(words), rnd.choice([None, "l"])) for w in order for n in range(width)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, CELLS)


def texts(cells):
    seqs = cells.groupBy("passage_id", "siglum", "wit_ord").agg(F.concat_ws("", F.sort_array(F.collect_list("reading"))).alias("seq"))
    return {
        "xml": (line_files.tei_matrix_lines(cells), writers.tei_matrix(cells)),
        "csv": (line_files.alignment_csv_lines(cells), writers.alignment_csv(cells)),
        "nex": (line_files.nexus_lines(cells), writers.nexus(cells)),
        "fasta": (line_files.fasta_lines(seqs), writers.fasta(seqs)),
    }


@pytest.mark.parametrize("ending", ["xml", "csv", "nex", "fasta"])
def test_files_equal_texts(spark, cells, tmp_path, ending):
    lines, whole = texts(cells)[ending]
    lines.persist()
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks for these few lines
    try:
        line_files.write_lines(lines, str(tmp_path / ending), ending)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    wanted = {r["passage_id"]: r["value"] for r in whole.collect()}
    folders = sorted(x.name for x in (tmp_path / ending).iterdir() if x.name.startswith("passage="))
    assert len(folders) == len(wanted)
    most = 0
    for folder in folders:
        parts = sorted(x for x in os.listdir(tmp_path / ending / folder) if x.startswith("part-"))
        text = "".join((tmp_path / ending / folder / x).read_text(encoding="utf-8") for x in parts)
        name = folder.removeprefix("passage=").removesuffix(f".{ending}").replace("%2F", "/")
        assert text == wanted[name] + "\n", name
        most = max(most, len(parts))
    assert most > 1 or ending == "csv"
    lines.unpersist()


def test_no_cells(cells):
    for lines, _ in texts(cells.limit(0)).values():
        assert lines.columns == line_files.LINES and lines.count() == 0
