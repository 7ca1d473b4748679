"""License scan by diagonal voting.

The rolling hashes of all k-grams of words of all documents are joined by Spark to the places of the same hashes in
license templates. Each match votes for its diagonal (place in the document less place in the template). Votes are
summed by diagonal, neighbouring diagonals are merged (an inserted or dropped word moves a match to the next one), and
the span of each merged diagonal is verified word by word against the template, in overlapping windows of three times
the template's length: a text that repeats a license for pages is verified in time proportional to its length.

The template side is a fixed list, so it is the broadcast side by construction. Documents are told apart by a 96-bit
hash and the length of their text, so equal texts are scanned as one key and never meet as rows.

Defined results: null text has no words; equal rows are scored alike, one row out for each row in; without templates
only the base phrases count; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, spread_left_join, stored, text_of
from .license_texts import TEMPLATES

K = 4
#: Diagonals at most so far apart belong together.
NEAR = 8
#: Share of a template's words that a verified span must hold in order.
COVERED = 0.8
#: A base phrase alone, outside any known statement, scores this much.
PHRASE_SCORE = 0.5

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The contract's phrases and labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()
_ODD = [int(xxhash.xxh64_intdigest(str(i).encode()) | 1) for i in range(64)]


def rolling(words: list[bytes], k: int = K) -> np.ndarray:
    """64-bit hashes of all k-grams."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += h[j : j + n] * np.uint64(_ODD[j])
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        arrays = [rolling(words_of(t)) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), grams], ["k1", "k2", "kn", "grams"])


def coverage(words: list[bytes], template: list[bytes]) -> float:
    """Share of the template's words that stand in the span in the template's order."""
    match = difflib.SequenceMatcher(None, words, template, autojunk=False)
    return sum(m.size for m in match.get_matching_blocks()) / len(template)


def windows(words: list[bytes], low: int, high: int, length: int) -> Iterator[tuple[bytes, ...]]:
    """A span in windows of ``3 * length`` words, each a ``length`` behind the one before: a match of up to twice the length lies in one."""
    low = max(0, low)
    while True:
        yield tuple(words[low : min(high, low + 3 * length)])
        if low + 3 * length >= high:
            return
        low += length


def _finish(templates: tuple[tuple[str, str], ...]):
    worded = [(label, words_of(t.encode())) for label, t in templates]
    phrases = [(p.encode().split(), label) for p, label in PHRASES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, tuple[bytes, ...]], float] = {}
        for batch, texts in slices(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            out: list[list] = [[] for _ in range(8)]
            for text, found in zip(texts, spans, strict=True):
                words = words_of(text)
                base, labels, first, last, best = [], set(), None, None, 0.0
                if b"icense" in text or b"ICENSE" in text or b"license" in text.lower():
                    for i, w in enumerate(words):
                        if w == b"license":
                            for phrase, label in phrases:
                                start = i - len(phrase) + 1
                                if start >= 0 and words[start : i + 1] == phrase:
                                    base.append(start)
                                    labels.add(label)
                base_labels = set(labels)
                if base:
                    first, last, best = min(base), max(base), PHRASE_SCORE
                for s in found or []:
                    label, template = worded[s["template"]]
                    for part in windows(words, s["low"], s["high"], len(template)):
                        key = (s["template"], part)
                        if key not in seen:
                            if len(seen) > 5_000:
                                seen.clear()
                            seen[key] = coverage(list(part), template)
                        if seen[key] >= COVERED:
                            labels.add(label)
                            best = max(best, seen[key])
                for values, v in zip(out, (len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), best, len(found or [])), strict=True):
                    values.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"])

    return run


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_spans long"


def spans_of(grams: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """Spans by text key: template, low and high (words of the document where the template would lie)."""
    spark = grams.sparkSession
    places = [(int(h), t, i, len(words)) for t, (_, text) in enumerate(templates) for words in [words_of(text.encode())] for i, h in enumerate(rolling(words).tolist())]
    known = F.broadcast(spark.createDataFrame(places or [], "gram long, template int, place int, length int"))
    key = ["k1", "k2", "kn", "template"]
    votes = grams.select("k1", "k2", "kn", F.posexplode("grams").alias("at", "gram")).join(known, "gram")
    # Equal texts give equal votes: counting distinct places keeps one of them.
    diagonals = votes.groupBy(*key, "length", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count_distinct("place").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    order = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(1))
    merged = diagonals.withColumn("group", F.sum(apart).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*key, "length", "group").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"))
    enough = merged.where(F.col("votes") * 3 >= F.greatest(F.col("length") - K + 1, F.lit(1)))
    span = F.struct("template", F.col("d0").alias("low"), (F.col("d1") + F.col("length")).alias("high"))
    return enough.groupBy("k1", "k2", "kn").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """RESULT: one row for each document."""
    text = text_of()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), F.octet_length(text).alias("kn"))
    grams = keyed.select("k1", "k2", "kn", "text").mapInArrow(_grams, "k1 long, k2 int, kn int, grams array<long>")
    spans = stored(spans_of(grams, templates), "spans")
    # Rows of a frequent text, with spans or without, are dealt out by their places in the files.
    found = spread_left_join(keyed.withColumn("at_", F.monotonically_increasing_id()), spans, ["k1", "k2", "kn"], ["at_"])
    return found.select("doc_id", "text", "spans").mapInArrow(_finish(templates), RESULT)
