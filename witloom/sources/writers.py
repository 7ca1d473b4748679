"""Sinks: TEI matrix, alignment CSV, NEXUS, apparatus, FASTA, scoring triples; each makes one text a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.translit import slp1_to_iast
from ..operators.coding import SYMBOLS, coded_readings, column_states, file_labels, nexus_rows, nexus_states
from ..operators.columns import ordered_join
from ..storage import stored

ROW = ["passage_id", "siglum", "wit_ord"]


def escaped(text: str | Column) -> Column:
    """The characters that XML reserves, as references."""
    text = F.col(text) if isinstance(text, str) else text
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def by_witness(value: str, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wit_ord", F.col(value).alias("v")))), lambda x: x["v"]), separator)


TEI = "http://www.tei-c.org/ns/1.0"
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def tei_word() -> Column:
    """A column's cell as ``w``; a lemma only where it differs."""
    lemma = F.when(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("reading")), F.concat(F.lit(' lemma="'), escaped("lemma"), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<w n="'), F.col("n").cast("string"), F.lit('"'), lemma, F.lit(">"), escaped("reading"), F.lit("</w>"))


def tei_text(words: str) -> Column:
    return F.concat(F.lit('<TEI n="'), escaped("siglum"), F.lit('"><text>'), words, F.lit("</text></TEI>"))


def tei_matrix(cells: DataFrame, slp1: bool = False) -> DataFrame:
    """passage_id, value: a TEI corpus with one text a witness and one ``w`` a column; a lemma only where it differs.

    ``slp1``: cells are in SLP1 and written in IAST.
    """
    if slp1:
        cells = cells.withColumns({c: slp1_to_iast(F.col(c)) for c in ("reading", "lemma")})
    rows = cells.groupBy(*ROW).agg(ordered_join(tei_word()).alias("ws")).withColumn("tei", tei_text("ws"))
    whole = rows.groupBy("passage_id").agg(by_witness("tei").alias("teis"))
    return whole.select("passage_id", F.concat(F.lit(f'{XML_HEAD}<teiCorpus xmlns="{TEI}">\n'), "teis", F.lit("\n</teiCorpus>")).alias("value"))


def csv_cell() -> Column:
    """A reading in quotes, quotes doubled."""
    return F.concat(F.lit('"'), F.replace("reading", F.lit('"'), F.lit('""')), F.lit('"'))


def alignment_csv(cells: DataFrame) -> DataFrame:
    """passage_id, value: a line a witness, cells in quotes, quotes doubled."""
    rows = cells.groupBy(*ROW).agg(ordered_join(csv_cell(), ",").alias("line")).withColumn("line", F.concat_ws(",", "siglum", "line"))
    return rows.groupBy("passage_id").agg(by_witness("line").alias("value"))


def nexus(cells: DataFrame) -> DataFrame:
    """passage_id, value: taxa, the format of the characters, state labels and the matrix. Readings are coded first."""
    cells = stored(coded_readings(cells), "coded")
    states = stored(column_states(cells), "states")
    quoted = F.concat(F.lit("'"), F.replace("siglum", F.lit("'"), F.lit("''")), F.lit("'"))
    rows = nexus_rows(nexus_states(cells, states)).withColumn("taxon", quoted).withColumn("line", F.concat("taxon", F.lit(" "), "states"))
    body = rows.groupBy("passage_id").agg(F.count("*").alias("ntax"), F.max(F.length("states")).alias("nchar"), by_witness("line").alias("matrix"), by_witness("taxon", " ").alias("taxa"))
    label = F.concat((F.col("n") + 1).cast("string"), F.lit(" / "), "labels")
    labels = file_labels(cells, states).groupBy("passage_id").agg(ordered_join(label, ",\n").alias("labels"))
    symbols = " ".join("0" + SYMBOLS)
    value = F.concat(
        F.lit("#NEXUS\n\nBEGIN TAXA;\n  DIMENSIONS NTAX="), F.col("ntax").cast("string"), F.lit(";\n  TAXLABELS "), "taxa", F.lit(";\nEND;\n\nBEGIN CHARACTERS;\n  DIMENSIONS NCHAR="), F.col("nchar").cast("string"),
        F.lit(f';\n  FORMAT DATATYPE=STANDARD RESPECTCASE GAP=- MISSING=? SYMBOLS="{symbols}";\n  CHARSTATELABELS\n'), "labels", F.lit("\n;\nMATRIX\n"), "matrix", F.lit("\n;\nEND;\n"),
    )
    return body.join(labels, "passage_id").select("passage_id", value.alias("value"))


def apparatus_tei(cells: DataFrame, base: DataFrame, entries: DataFrame) -> DataFrame:
    """passage_id, value: the base text as TEI with ``app`` where others differ, below a header that lists the witnesses.

    ``entries`` as of :func:`witloom.operators.apparatus.entries`; sigla stand in ``wit`` with ``#``; the trailing space of a
    lemma stands behind its entry.
    """
    pointers = lambda wits: F.array_join(F.transform(wits, lambda w: F.concat(F.lit("#"), escaped(w))), " ")
    own = cells.join(base, "passage_id").where("siglum = base").select("passage_id", "n", "reading").join(entries, ["passage_id", "n"], "left")
    lem = F.concat(F.lit("<lem"), F.when(F.size("positive") > 0, F.concat(F.lit(' wit="'), pointers("positive"), F.lit('"'))).otherwise(""), F.lit(">"), escaped(F.rtrim("reading")), F.lit("</lem>"))
    rdgs = F.array_join(F.transform("negative", lambda x: F.concat(F.lit('<rdg wit="'), pointers(x["sigla"]), F.lit('">'), escaped(x["variant"]), F.lit("</rdg>"))), "")
    app = F.concat(F.lit("<app>"), lem, rdgs, F.lit("</app>"), F.when(F.endswith("reading", F.lit(" ")), " ").otherwise(""))
    text = own.groupBy("passage_id").agg(ordered_join(F.when(F.col("negative").isNotNull(), app).otherwise(escaped("reading"))).alias("body"))
    abbr = lambda c: F.concat(F.lit('<abbr type="siglum">'), escaped(c), F.lit("</abbr>"))
    witness = F.concat(F.lit('<witness xml:id="'), escaped("siglum"), F.lit('">'), abbr("siglum"), F.lit("</witness>"))
    wits = cells.select(*ROW).distinct().withColumn("w", witness).groupBy("passage_id").agg(by_witness("w").alias("list"))
    value = F.concat(
        F.lit(f'{XML_HEAD}<TEI xmlns="{TEI}" n="'), escaped("base"), F.lit('">\n<teiHeader><fileDesc><sourceDesc><msDesc><msIdentifier>'), abbr("base"), F.lit("</msIdentifier></msDesc>\n<listWit>\n"), "list",
        F.lit("\n</listWit></sourceDesc></fileDesc></teiHeader>\n<text><body><p>"), "body", F.lit("</p></body></text></TEI>"),
    )
    return text.join(wits, "passage_id").join(base, "passage_id").select("passage_id", value.alias("value"))


def fasta(witnesses: DataFrame) -> DataFrame:
    """passage_id, value: ``>siglum`` and the text, witness after witness."""
    return witnesses.withColumn("record", F.concat(F.lit(">"), "siglum", F.lit("\n"), "seq")).groupBy("passage_id").agg(by_witness("record").alias("value"))


def subst_triples(labels: DataFrame, matrix: DataFrame) -> DataFrame:
    """a, b, line: ``0xHEX 0xHEX score`` for every two labels of a scoring matrix; X where there is no score.

    Labels are single characters of one alphabet: their product is as small as the matrix.
    """
    both = labels.select(F.col("label").alias("a")).crossJoin(F.broadcast(labels.select(F.col("label").alias("b"))))
    code = lambda c: F.concat(F.lit("0x"), F.hex(F.ascii(c)))
    return both.join(F.broadcast(matrix), ["a", "b"], "left").select("a", "b", F.concat_ws(" ", code("a"), code("b"), F.coalesce(F.col("score").cast("string"), F.lit("X"))).alias("line"))


def write_passages(texts: DataFrame, path: str, ending: str) -> None:
    """One folder a passage, named by it: a partitioned text table (passage_id, value)."""
    texts.select("value", F.concat(F.col("passage_id").cast("string"), F.lit(f".{ending}")).alias("passage")).write.partitionBy("passage").text(path)
