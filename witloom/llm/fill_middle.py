"""Fill-in-the-middle: cuts texts into prefix, middle and suffix and writes them in another order.

Places are found in the UTF-8 itself, eight bytes at a time: the texts of a slice lie in one buffer, seen as unsigned 64-bit
words. A byte ends a code point unless the byte behind it continues one (its top bits are 10), which shifts and masks tell
for all eight bytes of a word; ``bitwise_count`` gives the ends in a word, their running sum is searched for the word that holds
the k-th end, and clearing the lowest marks finds it in the word. No text is decoded and no code point looked at on its own.

Which form and which cuts a document gets follows from the sha256 of the seed and its id alone, so reruns and other
partitionings agree. A document that is empty or contains a marker stays plain.

Defined results: a null text counts as empty; a null id hashes as the empty text; rows that share an id get the same numbers (each
takes them by its own length); further columns go along, but those named as a result's give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

ONES = np.uint64(0x0101010101010101)
U1, U6, U7, U8, U56 = (np.uint64(x) for x in (1, 6, 7, 8, 56))


@dataclass(frozen=True)
class Forms:
    """Markers, and of a hundred documents those that change form and, of them, those whose suffix comes first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    changed: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        if any(m[:1] in m[1:] or not m for m in self.markers) or len(set(self.markers)) < 3 or len({m[:1] for m in self.markers}) > 1:
            raise ValueError("markers must differ, begin with the same character, and hold it only there")

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Ends:
    """Ends of code points in a buffer of UTF-8: how many lie before a place, and where the k-th lies."""

    def __init__(self, raw: bytes | np.ndarray):
        data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
        # A word of zeros behind the last byte: it continues nothing.
        words = np.zeros(len(data) // 8 + 2, np.uint64)
        words.view(np.uint8)[: len(data)] = data
        starts = ~(words >> U7 & ~(words >> U6)) & ONES
        self.marks = starts[:-1] >> U8 | starts[1:] << U56
        self.marks[len(data) // 8] &= (U1 << np.uint64(8 * (len(data) % 8))) - U1
        self.upto = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def before(self, place: np.ndarray) -> np.ndarray:
        """How many ends lie before byte ``place``."""
        word, bits = place >> 3, (place & 7).astype(np.uint64) * U8
        below = np.bitwise_count(self.marks[word] & (U1 << bits) - U1).astype(np.int64)
        return np.where(word > 0, self.upto[word - 1], 0) + below

    def behind(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th end, counted from 1; 0 for k = 0."""
        word = np.searchsorted(self.upto, k)
        rest, mark = k - np.where(word > 0, self.upto[word - 1], 0), self.marks[word]
        for step in range(1, 8):
            mark = np.where(rest > step, mark & mark - U1, mark)
        low = mark & ~mark + U1
        return np.where(k > 0, word * 8 + (np.bitwise_count(low - U1) >> 3) + 1, 0).astype(np.int64)


def cuts(buffer: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each text, those before its two cuts, and the cuts' places in the buffer (rows by two)."""
    ends = Ends(buffer)
    base = ends.before(offsets)
    n = np.diff(base)
    points = np.sort(hashes % (n + 1)[:, None], axis=1)
    return n, points, ends.behind(base[:-1, None] + points)


def _forms(forms: Forms, kept: list[str]):
    p, s, m = (x.encode() for x in forms.markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text_"):
            held = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            h = np.stack([batch.column(batch.schema.get_field_index(f"h{k}_")).to_numpy() for k in (1, 2, 3, 4)], axis=1)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            n, points, places = cuts(buffer, offsets, h[:, :2])
            form, output = [], []
            for k, text in enumerate(texts):
                if not text or p in text or s in text or m in text or h[k, 2] % 100 >= forms.changed:
                    form.append("plain")
                    output.append(text)
                    continue
                i, j = places[k] - offsets[k]
                form.append("spm" if h[k, 3] % 100 < forms.suffix_first else "psm")
                first, last = (s + text[j:], p + text[:i]) if form[-1] == "spm" else (p + text[:i], s + text[j:])
                output.append(first + last + m + text[i:j])
            plain = np.array([f == "plain" for f in form], bool)
            count = lambda x: pa.array(x, pa.int64(), mask=plain)  # noqa: B023, E731
            columns = [pa.array(n, pa.int64()), pa.array(form), count(points[:, 0]), count(points[:, 1] - points[:, 0]), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([*held, *columns], [*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, forms: Forms = Forms(), column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with n, form (plain, psm, spm), prefix_chars, middle_chars and output (text)."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output", "h1_", "h2_", "h3_", "h4_", "text_")
    kept = [c for c in docs.columns if c != column and c not in made]
    digest = F.sha2(F.concat(F.lit(f"{forms.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}_") for k in range(4)]
    rows = docs.select(*kept, *hashes, text_of(column).cast("binary").alias("text_"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    done = rows.mapInArrow(_forms(forms, kept), f"{schema}n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, forms: Forms = Forms()) -> Column:
    """The text behind an output: markers occur once each, as texts that hold one stay plain."""
    between = lambda x, a, b: F.substring_index(F.substring_index(x, a, -1), b, 1)
    middle = F.substring_index(output, forms.middle, -1)
    psm = F.concat(between(output, forms.prefix, forms.suffix), middle, between(output, forms.suffix, forms.middle))
    spm = F.concat(between(output, forms.prefix, forms.middle), middle, between(output, forms.suffix, forms.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, forms: Forms = Forms()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the sha256 of output and restored text."""
    done = transform(docs.select("doc_id", "text"), forms)
    back = restored(F.col("output"), F.col("form"), forms)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""
