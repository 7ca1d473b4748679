"""Packing token sequences by minimum bin slack.

Every document becomes token ids plus one end id and is cut into full windows and one remainder. The remainders are
packed window by window: the longest piece left opens a window, and a bitset subset-sum over the lengths still in
stock finds the multiset that fills the window closest to its capacity; the counts are read back from the bitsets. A
multiset is used as often as the stock allows, so at most as many multisets are made as there are lengths.

Only the histogram of lengths (at most ``capacity`` rows, whatever the corpus) reaches the driver. The pieces are
matched to places by their rank within a length; ranks come from (length, salt) groups and running counts; a
length of n pieces has about sqrt(n) groups of sqrt(n) pieces, so no length, however common, is sorted in one task.

Defined results: null text is the empty text (one piece with the end id alone); equal rows are separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_of

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Bytes of text that are cut into words together.
TOGETHER = 6_000_000
#: How the vocabulary's own rules cut a lower-case word of plain characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Plain characters: printable ASCII and the letters of Latin-1 (no combining marks, one lower-case form each).
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
# Classes of bytes: line end, letter, digit, mark, first and second byte of a Latin-1 letter, anything else.
END, LETTER, DIGIT, MARK, FIRST, SECOND, ODD = range(7)
CLASSES = np.full(256, ODD, np.uint8)
CLASSES[33:127] = MARK
CLASSES[65:91] = CLASSES[97:123] = LETTER
CLASSES[48:58] = DIGIT
CLASSES[10], CLASSES[0xC3], CLASSES[0x80:0xC0] = END, FIRST, SECOND


def cut_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which ``words`` are plain; those in lower case, end to end; where their pieces start; pieces of each.

    A word with an apostrophe is none of these: its pieces need the pattern.
    """
    raw = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
    kind = CLASSES[raw]
    before = np.concatenate([np.array([10], np.uint8), raw[:-1]])
    ends = np.flatnonzero(kind == END)
    starts = np.concatenate([[0], ends[:-1] + 1])
    second = kind == SECOND
    odd = (kind == ODD) | (raw == ord("'")) | (second & ((before != 0xC3) | (raw == 0x97) | (raw == 0xB7))) | ((raw == ord("|")) & (before == ord("<")))
    odd[:-1] |= (kind[:-1] == FIRST) & ~second[1:]
    plain = ~np.logical_or.reduceat(odd, starts)
    low = raw + np.uint8(32) * (((kind == LETTER) & (raw < 97)) | (second & (raw <= 0x9E)))
    kind = np.where((kind == FIRST) | second, np.uint8(LETTER), kind)
    first = (kind != END) & ((kind != np.concatenate([np.array([END], np.uint8), kind[:-1]])) | (kind == DIGIT))
    kept = np.repeat(plain, ends - starts + 1) & (kind != END)
    return plain, low[kept], np.flatnonzero(first[kept]), np.add.reduceat(first, starts, dtype=np.int64)[plain]


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` with these starts and lengths, end to end."""
    upto = np.cumsum(lengths)
    return pool[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - lengths), lengths)]


class WordIds:
    """Ids of words without white space: no token of this vocabulary spans white space.

    New plain words are cut together as arrays; their different pieces, joined by spaces, go through the same merges in
    one call, and the tokens that end a piece show where its ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values of byte-level vocabularies: these bytes stand for themselves
        self.letters = np.arange(256, dtype="<u4")
        moved = [b for b in range(256) if b not in kept]
        self.letters[moved] = np.arange(256, 256 + len(moved))
        self.letters[32] = 32
        self.forget()

    def forget(self) -> None:
        """The empty word, at place 0, has no ids."""
        self.places: dict[bytes, int] = {b"": 0}
        self.pool, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _piece_ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different pieces end to end, and each piece's start and length there."""
        n = len(starts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), n, [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        kinds = coded.dictionary
        at = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
        low = np.frombuffer(kinds.buffers()[2], np.uint8)[at[0] : at[-1]]
        spaced = np.full(len(low) + len(kinds), 32, np.uint8)
        spaced[np.arange(len(low)) + np.repeat(np.arange(len(kinds)), np.diff(at))] = low
        ids = np.array(self.pieces.encode_batch_fast([self.letters[spaced].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(kinds):
            raise ValueError("the vocabulary does not mark the ends of pieces")
        first = np.concatenate([[0], ends[:-1]])
        which = coded.indices.to_numpy()
        return ids, first[which], (ends - first)[which]

    def learn(self, words: list[bytes]) -> None:
        plain, data, starts, pieces = cut_words(words)
        ids, first, lengths = self._piece_ids(data, starts)
        upto = np.cumsum(pieces)
        size = np.add.reduceat(lengths, upto - pieces) if len(pieces) else np.zeros(0, np.int64)
        rest = [np.array(self.slow(w), "<u4") for w in (words[i] for i in np.flatnonzero(~plain).tolist())]
        more = np.concatenate([size, np.array([len(x) for x in rest], np.int64)])
        base, held = len(self.places), len(self.pool)
        self.pool = np.concatenate([self.pool, gathered(ids, first, lengths), *rest])
        self.starts, self.lengths = np.concatenate([self.starts, held + np.cumsum(more) - more]), np.concatenate([self.lengths, more])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]).tolist()
        self.places.update(zip([words[i] for i in order], range(base, base + len(words)), strict=True))

    def slow(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if PLAIN.match(text) and "<|" not in text:
            cut = PIECES.findall(text.lower())
            joined = self.letters[np.frombuffer(" ".join(cut).encode(), np.uint8)].tobytes().decode("utf-32-le")
            return self.pieces.encode(joined, add_special_tokens=False).ids
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (an array of binary) end to end, and how many each has."""
        coded = words.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        if len(self.places) > REMEMBERED:
            self.forget()
        if missing := [w for w in kinds if w not in self.places]:
            self.learn(missing)
        at = np.fromiter(map(self.places.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        return gathered(self.pool, self.starts[at], self.lengths[at]), self.lengths[at]


_words: dict[str, WordIds] = {}


def cut_pieces(tokenizer_path: str, end_id: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words.get(tokenizer_path) or _words.setdefault(tokenizer_path, WordIds(tokenizer_path))
        for batch, texts in slices(batches, "text", TOGETHER):
            # Bytes as they are: words are cut at ASCII white space alone.
            split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
            ids, sizes = known.ids_of(split.flatten().view(pa.large_binary()))
            upto = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
            ids = np.insert(ids, upto[1:], end_id).astype("<u4")
            bounds = (upto + np.arange(len(upto))).tolist()
            raw = memoryview(ids.tobytes())
            out: list[list] = [[], [], [], [], []]
            for doc, low, high in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                for start in range(low, high, capacity):
                    length = min(capacity, high - start)
                    for values, v in zip(out, (doc, start - low, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), high - low), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def best_fill(stock: dict[int, int], capacity: int, rest: int) -> list[tuple[int, int]]:
    """The multiset of lengths in ``stock`` whose sum comes closest to ``rest`` without exceeding it.

    Lengths are taken from long to short; a power-of-two split of each count keeps the bitsets few. The search ends as
    soon as ``rest`` itself is reachable.
    """
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for length in sorted((x for x in stock if x <= rest and stock[x]), reverse=True):
        left, size = min(stock[length], rest // length), 1
        while left and not reach >> rest & 1:
            size = min(size, left)
            grown = (reach | reach << size * length) & mask
            steps.append((length, size, reach))
            reach, left, size = grown, left - size, size * 2
        if reach >> rest & 1:
            break
    total = reach.bit_length() - 1
    # An unfilled window costs nothing if its sum is a power of two.
    if total < rest:
        used = capacity - rest
        free = [1 << b for b in range(capacity.bit_length()) if used <= 1 << b <= used + total and reach >> ((1 << b) - used) & 1]
        total = free[-1] - used if free else total
    out: dict[int, int] = {}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + size
            total -= size * length
    return sorted(out.items(), reverse=True)


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number of ranks, per window, offset in the window, first window), from the stock of lengths."""
    stock, used, rows, window = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    for longest in sorted(histogram, reverse=True):
        while stock[longest]:
            stock[longest] -= 1
            chosen = dict(best_fill(stock, capacity, capacity - longest))
            stock[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(stock[x] // n for x, n in chosen.items())
            offset = 0
            for length, n in sorted(chosen.items(), reverse=True):
                rows.append((length, used[length], n * times, n, offset, window))
                stock[length] -= n * times
                used[length] += n * times
                offset += n * length
            window += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """One row per piece: PIECE plus sequence_id and offset. No sequence is longer than ``capacity``."""
    spark: SparkSession = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(cut_pieces(tokenizer_path, end_id, capacity), PIECE)
    pieces = stored(pieces, "pieces")
    # At most ``capacity`` rows, one for each length that a piece can have.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple]] = {length: [] for length in histogram}
    for length, *row in plan_windows(histogram, capacity):
        slots[length].append(tuple(row))
    known = spark.createDataFrame(
        [(length, isqrt(n) + 1, slots[length]) for length, n in histogram.items()],
        "length long, salts long, slots array<struct<first_rank:long,ranks:long,per_window:long,base:long,first_window:long>>",
    )
    salted = pieces.join(F.broadcast(known.select("length", "salts")), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")))
    counts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("within") + F.col("before"))
    # The plan's rows of one length tile its ranks without overlap: an equi-join on length, then one row fits.
    placed = ranked.join(F.broadcast(known.select("length", "slots")), "length").withColumn(
        "slot", F.element_at(F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") < s["first_rank"] + s["ranks"])), 1)
    )
    at = F.col("rank") - F.col("slot.first_rank")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("slot.first_window") + F.floor(at / F.col("slot.per_window"))).cast("long").alias("sequence_id"),
        (F.col("slot.base") + F.pmod(at, F.col("slot.per_window")) * F.col("length")).cast("long").alias("offset"),
    )
