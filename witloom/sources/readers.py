"""Sources: FASTA, aligned TEI, alignment CSV, NeXML trees, scoring matrices, TEI editions.

Files of many records (FASTA, TEI corpora, NeXML) are read in splits, by the text that ends a record (:func:`pieces`), so one large
file is many tasks; others are read whole (``wholetext``). The parsing functions take rows (path, value) and work on any such table.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.translit import iast_to_slp1
from ..storage import stored


def file_title() -> Column:
    """The file's name without its ending."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path (the file's name without its ending) and value (its text)."""
    return spark.read.text(path, wholetext=True).select(file_title().alias("path"), "value")


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """path, file, piece, value: the texts between two ``end``, numbered from 0 in each file; ``end`` itself goes.

    A file is read in splits (``spark.sql.files.maxPartitionBytes``), and a piece belongs to the split in which it begins. Numbers are
    running counts: a piece's place in its split plus the pieces of the splits before. Only these counts, one row a split, are
    brought together; pieces stay where they are read. They are written once, as other splits in a second reading would count
    otherwise. Nothing stands behind a last ``end``. Files of one name in several folders keep their own numbers.
    """
    read = spark.read.option("lineSep", end).text(path)
    cut = stored(read.select(file_title().alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"), "pieces")
    # A split lies in one task, where ids go up by one: its first id tells each piece's place.
    splits = cut.groupBy("file", "split").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return cut.join(starts, ["file", "split"]).select("path", "file", (F.col("at") + F.col("shift")).alias("piece"), "value")


#: A prefix of an element or attribute, which may be bound outside the piece that holds it.
PREFIX = re.compile(r"[<\s]([^\W\d][\w.-]*):[\w.-]+(?=[\s=/>])")


def standing_alone(text: str, name: str) -> str | None:
    """A piece of a file as an XML document: from the first ``name`` on, its end put back, prefixes bound; none if no ``name`` starts in it.

    Comments go before the name is looked for.
    """
    begun = re.search(rf"<{name}(?=[\s>])", text := re.sub(r"(?s)<!--.*?-->", "", text))
    if begun is None:
        return None
    body = text[begun.start() :]
    bound = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(PREFIX.findall(body)) - {"xml", "xmlns"}))
    return f"<piece{bound}>{body}</{name}></piece>"


def xml_pieces(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, value, piece: the elements ``name`` of XML files as documents, in splits of files.

    Elements of this name don't nest, are written without a prefix and end in ``</name>`` without white space; entities declared in a
    file's head aren't known. A piece without a begun element (behind the last, or between comments) has no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([standing_alone(t, name) for t in b.column("value").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("path"), made, b.column("piece")], ["path", "value", "piece"]).filter(made.is_valid())

    return pieces(spark, path, f"</{name}>").select("path", "value", "piece").mapInArrow(run, "path string, value string, piece long")


def root_of(text: str | None) -> ET.Element | None:
    """The root element; none of a missing or malformed file, which then has no rows (see :func:`rejected`)."""
    try:
        return ET.fromstring(text) if text else None
    except ET.ParseError:
        return None


def elements(text: str | None, name: str) -> list[ET.Element]:
    root = root_of(text)
    return [] if root is None else [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


def rejected(files: DataFrame) -> DataFrame:
    """path, error: the files that XML readers leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    ET.fromstring(text or "")
                except ET.ParseError as error:
                    rows.append((path, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["path", "error"])

    return files.select("path", "value").mapInArrow(run, "path string, error string")


def fasta_rows(records: DataFrame) -> DataFrame:
    """passage_id, siglum, wit_ord, seq of ``records`` (passage_id, wit_ord, record), a record being what stands behind a ``>``."""
    head = F.regexp_extract("record", r"^([^\r\n]*)", 1)
    return records.select("passage_id", F.trim(head).alias("siglum"), "wit_ord", F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"[\r\n]", "").alias("seq"))


def parse_fasta(files: DataFrame) -> DataFrame:
    """passage_id, siglum, wit_ord, seq: the header is the rest of a ``>`` line, trimmed; line ends in sequences go."""
    return fasta_rows(files.select(F.col("path").alias("passage_id"), F.posexplode(F.slice(F.split("value", ">"), 2, 2**31 - 1)).alias("wit_ord", "record")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`parse_fasta` from files read in splits: the first piece of a file, before any ``>``, is no record."""
    return fasta_rows(pieces(spark, path, ">").where("piece > 0").select(F.col("path").alias("passage_id"), (F.col("piece") - 1).cast("int").alias("wit_ord"), F.col("value").alias("record")))


def parse_alignment_csv(files: DataFrame) -> DataFrame:
    """Cells of alignment CSVs: siglum, then one field a column. Quoted fields are kept as they are, others trimmed."""
    # Line ends outside quotes become record separators; those inside belong to their field.
    parts = F.regexp_extract_all("value", F.lit(r'"[^"]*"|[^"\r\n]+|\r?\n|"'), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda x: F.when(x.isin("\n", "\r\n"), "\x1e").otherwise(x)), "")
    lines = files.select(F.col("path").alias("passage_id"), F.posexplode(F.split(joined, "\x1e")).alias("wit_ord", "line")).where("trim(line) <> ''")
    raw = F.regexp_extract_all("line", F.lit(r'(?:^|,)((?:"[^"]*")+|[^,"]*)'), F.lit(1))
    clean = F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(f)))
    fields = lines.select("passage_id", "wit_ord", "line", clean.alias("f"))
    # A line that ends in a comma has no field behind it.
    kept = F.when((F.size("f") > 1) & F.endswith("line", F.lit(",")), F.slice("f", 1, F.size("f") - 1)).otherwise(F.col("f"))
    named = fields.select("passage_id", "wit_ord", F.element_at("f", 1).alias("siglum"), F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))).alias("cells"))
    return named.select("passage_id", "siglum", "wit_ord", F.posexplode("cells").alias("n", "reading"))


def read_alignment_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_alignment_csv(whole_files(spark, path))


#: Rows of one Arrow batch that a reader gives back, about: a batch for each small text costs more than its reading.
ROWS = 50_000


def gathered(texts: Iterable[list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The rows of many texts as batches of ROWS; the last text of a batch may exceed it."""
    held: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for rows in texts:
        held += rows
        if len(held) >= ROWS:
            yield made()
            held = []
    if held:
        yield made()


def _tei_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["passage_id", "siglum", "wit_ord", "n", "reading", "lemma", "emended", "group_id", "insignificant", "binary"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_()]
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def read(path: str, text: str | None, first: int) -> Iterator[tuple]:
        for order, tei in enumerate(elements(text, "TEI"), first):
            groups = {id(w): g for g, cl in enumerate(e for e in tei.iter() if local(e) == "cl") for w in cl.iter()}
            for w in tei.iter():
                if local(w) == "w":
                    on = lambda a: w.get(a) == "true"  # noqa: B023, E731
                    yield (path, tei.get("n"), order, int(w.get("n")), "".join(w.itertext()), w.get("lemma"), on("emended"), groups.get(id(w)), on("insignificant"), on("binary"))

    yield from gathered((list(read(*row)) for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)), names, types)


def parse_tei_matrix(files: DataFrame) -> DataFrame:
    """Cells with attributes and groups of aligned TEI corpora; spaces in cells are kept, inline children read as their text.

    Witnesses are counted from 0 in each row, or from its ``piece`` where ``files`` has that column.
    """
    first = F.col("piece") if "piece" in files.columns else F.lit(0)
    return files.select("path", "value", first.cast("int").alias("first")).mapInArrow(_tei_cells, "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string, emended boolean, group_id int, insignificant boolean, binary boolean")


def read_tei_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The cells of corpora read in splits, one text a piece; a malformed text has no rows and leaves the others theirs.

    ``rejected(xml_pieces(spark, path, "TEI"))`` lists such texts.
    """
    return parse_tei_matrix(xml_pieces(spark, path, "TEI"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree_id", "kind", "id", "label", "otu", "is_root", "source", "target", "length", "edge_ord"]
    types = [pa.string()] * 5 + [pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int32()]
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def read(text: str | None) -> Iterator[tuple]:
        for tree in elements(text, "tree"):
            for k, e in enumerate(tree):
                if local(e) == "node":
                    yield (tree.get("id"), "node", e.get("id"), e.get("label"), e.get("otu"), e.get("root") == "true", None, None, None, None)
                elif local(e) == "edge":
                    yield (tree.get("id"), "edge", e.get("id"), None, None, None, e.get("source"), e.get("target"), float(e.get("length") or 0), k)

    yield from gathered((list(read(text)) for batch in batches for text in batch.column(1).to_pylist()), names, types)


def parse_trees(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of NeXML trees, several to a file."""
    rows = files.select("path", "value").mapInArrow(_trees, "tree_id string, kind string, id string, label string, otu string, is_root boolean, source string, target string, length double, edge_ord int")
    nodes = rows.where("kind = 'node'").select("tree_id", F.col("id").alias("node_id"), "label", "otu", "is_root")
    return nodes, rows.where("kind = 'edge'").select("tree_id", F.col("id").alias("edge_id"), "edge_ord", "source", "target", "length")


def read_trees(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of NeXML files read in splits, one tree a piece."""
    return parse_trees(stored(xml_pieces(spark, path, "tree"), "trees"))


def parse_subst_matrix(files: DataFrame) -> DataFrame:
    """(a, b, score) of ``;`` matrices: column labels in the first line, a row label first in the others; labels become SLP1."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where("trim(text) <> ''")
    cells = lines.select("path", "line", F.filter(F.split("text", ";"), lambda x: x != "").alias("f"))
    header = cells.where("line = 0").select("path", F.posexplode("f").alias("k", "b"))
    body = cells.where("line > 0").select("path", F.element_at("f", 1).alias("a"), F.posexplode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("k", "score"))
    return body.join(header, ["path", "k"]).select("path", iast_to_slp1(F.col("a")).alias("a"), iast_to_slp1(F.col("b")).alias("b"), F.col("score").cast("double").alias("score"))


def read_subst_matrix(spark: SparkSession, path: str) -> DataFrame:
    return parse_subst_matrix(whole_files(spark, path))
