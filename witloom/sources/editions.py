"""TEI editions: plain text under a tag policy, and the texts of variant witnesses from an inline apparatus."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import root_of

# Elements left out with their content. Others lose their tags only.
IGNORED = frozenset("abbr cb corr del ex gap label lb locus metamark milestone note num pb ptr rdg space surplus anchor caesura".split())
BLOCKS = frozenset(("p", "lg", "l"))
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


class _Text(HTMLParser):
    """Text outside ignored elements; markup need not be well-formed."""

    def __init__(self, ignored: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.ignored, self.parts, self.inside = ignored, [], []

    def handle_starttag(self, tag, attrs):
        if self.inside or tag in self.ignored:
            self.inside.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.inside:
            self.parts.append(data)


def policy_text(documents: DataFrame, column: str, ignored: frozenset[str] = IGNORED) -> DataFrame:
    """Replaces ``column`` by its plain text: ignored elements dropped, white space collapsed and trimmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, out = b.schema.get_field_index(column), []
            for text in b.column(b.schema.get_field_index(column)).to_pylist():
                parser = _Text(ignored)
                parser.feed(text or "")
                parser.close()
                out.append(" ".join("".join(parser.parts).split()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == i else c for k, c in enumerate(b.columns)], b.schema.names)

    return documents.mapInArrow(run, documents.schema)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "siglum", "witnesses", "passage_id", "seg_no", "app_no", "kind", "wits", "text"]
    strings = pa.list_(pa.string())
    types = [pa.string(), pa.string(), strings, pa.string(), pa.int32(), pa.int32(), pa.string(), strings, pa.string()]

    def plain(e: ET.Element, out: list[str]) -> None:
        if _local(e) in IGNORED - {"rdg"}:
            return
        out.append(e.text or "")
        for child in e:
            plain(child, out)
            out.append(child.tail or "")

    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root, rows = root_of(text), []
            if root is None:
                continue
            siglum = next((e.text for e in root.iter() if _local(e) == "idno" and e.get("type") == "siglum"), None)
            listed = [e.get(XML_ID) for e in root.iter() if _local(e) == "witness" and e.get(XML_ID)]
            for block in (e for e in root.iter() if _local(e) in BLOCKS and e.get(XML_ID)):
                seg, app = [0], [0]

                def emit(kind: str, app_no, wits: list[str], value: str, seg=seg, block=block) -> None:
                    rows.append((path, siglum, listed, block.get(XML_ID), seg[0], app_no, kind, wits, value))
                    seg[0] += 1

                def walk(e: ET.Element, app=app, emit=emit) -> None:
                    name = _local(e)
                    if name in IGNORED:
                        return
                    if name == "app":
                        for part in e:
                            if _local(part) in ("lem", "rdg"):
                                out: list[str] = []
                                plain(part, out)
                                emit(_local(part), app[0], [w.lstrip("#") for w in (part.get("wit") or "").split()], "".join(out))
                        app[0] += 1
                        return
                    if e.text:
                        emit("text", None, [], e.text)
                    for child in e:
                        walk(child)
                        if child.tail:
                            emit("text", None, [], child.tail)

                walk(block)
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def segments(documents: DataFrame) -> DataFrame:
    """``documents`` (path, value): segments of every block with an id: running text, and lemmas and readings by apparatus."""
    return documents.select("path", "value").mapInArrow(_segments, "doc_id string, siglum string, witnesses array<string>, passage_id string, seg_no int, app_no int, kind string, wits array<string>, text string")


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = root_of(text)
            blocks = () if root is None else (e.get(XML_ID) for e in root.iter() if _local(e) in BLOCKS and e.get(XML_ID))
            rows += [(path, k, name) for k, name in enumerate(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["doc_id", "passage_ord", "passage_id"])


def passage_ids(documents: DataFrame) -> DataFrame:
    """doc_id, passage_ord, passage_id: every block with an id of ``documents`` (path, value), empty ones too, in the order of the text."""
    return documents.select("path", "value").mapInArrow(_block_ids, "doc_id string, passage_ord int, passage_id string")


def default_passages(documents: DataFrame, first: str | None = None) -> DataFrame:
    """passage_ord, passage_id: the passages taken where none are named, those of document ``first``, by default the first path in order.

    Only that document is parsed. If it is malformed or has no ids, or there are no documents, there are no passages; an id that
    stands twice counts where it stands first.
    """
    lead = documents.agg(F.min("path").alias("path")) if first is None else documents.sparkSession.createDataFrame([(first,)], "path string")
    ids = passage_ids(documents.join(F.broadcast(lead), "path", "left_semi"))  # one row
    return ids.groupBy("passage_id").agg(F.min("passage_ord").alias("passage_ord")).select("passage_ord", "passage_id")


def passage_select(parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Segments of the passages in ``wanted`` (passage_id)."""
    return parsed.join(wanted.select("passage_id").distinct(), "passage_id", "left_semi")


def variant_texts(parsed: DataFrame) -> DataFrame:
    """One text for each witness of a passage: in each apparatus entry its reading, else the lemma, else nothing.

    Witnesses are the document's list or else all that readings name.
    """
    key = ["doc_id", "passage_id"]
    named = parsed.select(*key, F.explode("wits").alias("wit")).distinct()
    listed = parsed.select(*key, F.explode("witnesses").alias("wit")).distinct()
    has_list = listed.select(*key).distinct()
    wits = listed.unionByName(named.join(has_list, key, "left_anti"))
    slots = parsed.withColumn("slot", F.coalesce(F.concat(F.lit("a"), F.col("app_no").cast("string")), F.concat(F.lit("s"), F.col("seg_no").cast("string"))))
    pairs = wits.join(slots, key)
    mine = F.when(F.col("kind") == "text", 1).when((F.col("kind") == "rdg") & F.array_contains("wits", F.col("wit")), 3).when(F.col("kind") == "lem", 2)
    best = pairs.withColumn("rank", mine).where("rank IS NOT NULL").groupBy(*key, "wit", "slot").agg(F.max_by("text", F.struct("rank", (-F.col("seg_no")).alias("o"))).alias("text"), F.min("seg_no").alias("seg_no"))
    joined = best.groupBy(*key, "wit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"]), "").alias("text"))
    return joined.select(*key, F.col("wit").alias("siglum"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
