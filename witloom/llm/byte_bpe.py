"""Byte-level BPE by ranks: length-bucketed padded matrices, one merge a row and round.

A text is cut by the pattern, and every match is encoded on its own. Matches that a worker has not met before become rows of
matrices of token ids, one matrix for each bucket of lengths, padded at the end. Each round looks at every row's pairs, takes
the leftmost one of least rank, and closes up the row; as each row loses one id a round, a matrix stays a matrix. Rows without
a pair left are done and leave. Ranks of pairs come from a hash table over (left id, right id), probed for whole matrices at
once, and only the two pairs beside a merge are looked up again. Matches of more than LONGEST bytes take the same merges in
the same order from a heap, as a matrix would take rounds times length. A worker keeps a bounded store of matches and ids.

Rank files hold ``base64 rank`` a line; the path is a parameter. Ids of a match that is itself in the file are that rank alone.

Defined results: a null text counts as empty and has no ids; special tokens are ordinary text; equal rows give equal
ids; further columns go along, but one named as a result (``ids``, ``decoded``) gives way; ids outside the file raise an error
when decoding.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

NONE = np.int32(2**31 - 1)
#: Lengths in bytes of the buckets; longer matches go to the heap.
BUCKETS = (2, 4, 6, 8, 12, 16, 32, 64, 128, 256, 512, 1024)
LONGEST = BUCKETS[-1]
#: Cells of one matrix at most; matches and ids that a worker keeps; characters of a text that are cut at once.
CELLS, KEPT, KEPT_IDS, PART = 1_000_000, 400_000, 4_000_000, 500_000


# Code points that later versions of Unicode than 16 made letters or numbers. Rank files' own library does not know
# them as such, while the regex module does.
YOUNGER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def cutter(pattern: str):
    """The function that cuts a text into matches of ``pattern``, with the character classes that rank files were cut by.

    White space is that of Unicode (the regex module also counts the separators 1C to 1F); letters and numbers are those
    outside YOUNGER, which only texts that hold one pay for.
    """
    younger = "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in YOUNGER.split())
    plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    narrow = plain
    for c in (r"\p{L}", r"\p{N}"):
        narrow = narrow.replace(c, f"[{c}--[{younger}]]")
    usual, careful, meets = regex.compile(plain).findall, regex.compile(narrow, regex.V1).findall, regex.compile(f"[{younger}]").search
    return lambda text: usual(text) if text.isascii() or not meets(text) else careful(text)


def read_ranks(lines) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Ranks of pairs of ids by hashing, for whole arrays: open addressing with a known longest probe."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key = self.keys(left, right)
        self.bits = max(4, int(len(key) * 2 - 1).bit_length()) if len(key) else 4
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        place, open_, self.probes = self.places(key), np.arange(len(key)), 1
        while len(open_):
            # Of the keys that want a free place one gets it; the others go one place on.
            free = open_[self.key[place[open_]] == -1]
            self.key[place[free]] = key[free]
            self.rank[place[free]] = rank[free]
            taken = self.key[place[open_]] == key[open_]
            self.rank[place[open_[taken]]] = rank[open_[taken]]
            open_ = open_[~taken]
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            self.probes += bool(len(open_))

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def places(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view(np.uint64) * self.FACTOR >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it does not merge (or an id is padding, -1)."""
        key = self.keys(np.maximum(left, 0), np.maximum(right, 0))
        place = self.places(key)
        held = self.key[place]
        out = np.where(held == key, self.rank[place], NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = place[open_] + 1 & (1 << self.bits) - 1
            held = self.key[place[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.rank[place[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Bpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = cutter(pattern)
        self.cut = regex.compile(r"\P{White_Space}(?=\p{White_Space})").search
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks some single bytes")
        split = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*(np.array([s[c] for s in split], np.int32) for c in range(3)))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        size = by_rank[-1][1] + 1
        self.sizes = np.full(size, -1, np.int64)
        self.sizes[[r for _, r in by_rank]] = [len(t) for t, _ in by_rank]
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.sizes, 0))])[:-1]
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # Ids of the k-th known match lie from at[k] to at[k + 1]; both arrays have room at their ends.
        self.at, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def merged(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of ``rows`` (ids, padded by -1), by and by: numbers of rows that are done, and their ids, padded."""
        number = np.arange(len(rows))
        rank = self.pairs.look(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        while rows.shape[1] > 1 and len(rows):
            j = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), j]
            done = least == NONE
            if done.any():
                yield number[done], rows[done]
                rows, rank, number, j, least = rows[~done], rank[~done], number[~done], j[~done], least[~done]
            each, width = np.arange(len(rows)), rows.shape[1]
            rows[each, j] = least
            left = np.ones(rows.shape, bool)
            left[each, j + 1] = False
            rows = rows[left].reshape(len(rows), width - 1)
            left = np.ones(rank.shape, bool)
            left[each, j] = False
            rank = rank[left].reshape(len(rows), width - 2)
            # The pairs that the new id makes with the ids before and behind it.
            for k in (j - 1, j):
                on = (k >= 0) & (k < width - 2)
                r, c = each[on], k[on]
                rank[r, c] = self.pairs.look(rows[r, c], rows[r, c + 1])
        if len(rows):
            yield number, rows

    def heaped(self, match: bytes) -> np.ndarray:
        """The same merges for one long match: pairs wait in a heap by rank and place."""
        ids = self.single[np.frombuffer(match, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        first = self.pairs.look(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (new := self.rank_of(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def rank_of(self, left: int, right: int) -> int | None:
        token = lambda r: self.bytes[self.starts[r] : self.starts[r] + self.sizes[r]].tobytes()
        return self.ranks.get(token(left) + token(right))

    def learn(self, matches: list[str]) -> None:
        """Put matches that are not known yet into the store."""
        coded = [m.encode() for m in matches]
        out: list[np.ndarray | None] = [None] * len(coded)
        buckets: dict[int, list[int]] = {}
        for k, m in enumerate(coded):
            if (whole := self.ranks.get(m)) is not None:
                out[k] = np.array([whole], np.int32)
            elif len(m) > LONGEST:
                out[k] = self.heaped(m)
            else:
                buckets.setdefault(next(b for b in BUCKETS if len(m) <= b), []).append(k)
        for width, members in buckets.items():
            for s in range(0, len(members), max(1, CELLS // width)):
                part = members[s : s + max(1, CELLS // width)]
                raw = np.frombuffer(b"".join(coded[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
                sizes = np.array([len(coded[k]) for k in part])
                rows = np.where(np.arange(width) < sizes[:, None], self.single[raw], np.int32(-1))
                for number, done in self.merged(rows):
                    held = (done >= 0).sum(axis=1)
                    for n, ids in zip(number.tolist(), np.split(done[done >= 0], np.cumsum(held)[:-1]), strict=True):
                        out[part[n]] = ids
        base, flat = len(self.known), np.concatenate(out)
        start, stop = self.at[base], base + len(out)
        if stop >= len(self.at):
            self.at = np.resize(self.at, 2 * (stop + 1))
        if start + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (start + len(flat)))
        self.at[base + 1 : stop + 1] = start + np.cumsum([len(x) for x in out])
        self.ids[start : start + len(flat)] = flat
        self.known.update(zip(matches, range(base, stop), strict=True))

    def parts(self, text: str) -> Iterator[str]:
        """A text cut before white space behind other characters, where matches always end, about every PART characters."""
        start = 0
        while len(text) - start > PART and (m := self.cut(text, start + PART)):
            yield text[start : m.end()]
            start = m.end()
        yield text[start:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts share rounds: new matches of about PART characters are learned together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, part in itertools.chain(((k, p) for k, t in enumerate(texts) for p in self.parts(t)), [(-1, "")]):
            if held and (k < 0 or size + len(part) > PART):
                self.look_up(held, out)
                held, size = [], 0
            held.append((k, self.find(part)))
            size += len(part)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def look_up(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        """Append the ids of the matches in ``held`` to their texts' lists in ``out``."""
        kinds = dict.fromkeys(itertools.chain.from_iterable(matches for _, matches in held))
        new = [m for m in kinds if m not in self.known]
        if len(self.known) + len(new) > KEPT or self.at[len(self.known)] > KEPT_IDS:
            self.forget()
            new = list(kinds)
        if new:
            self.learn(new)
        for k, matches in held:
            which = np.fromiter(map(self.known.__getitem__, matches), np.int64, len(matches))
            out[k].append(gathered(self.ids, self.at[which], self.at[which + 1] - self.at[which]))

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or (self.sizes[ids] < 0).any()):
            raise ValueError("ids outside the rank file")
        out = [gathered(self.bytes, self.starts[x], self.sizes[x]).tobytes() for x in (ids[s : s + PART] for s in range(0, len(ids), PART))]
        return b"".join(out)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from ``starts`` of ``sizes``, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


_LOADED: dict[tuple[str, str], Bpe] = {}


def _loaded(name: str, pattern: str) -> Bpe:
    if (name, pattern) not in _LOADED:
        with open(SparkFiles.get(name), "rb") as lines:
            _LOADED[name, pattern] = Bpe(read_ranks(lines), pattern)
    return _LOADED[name, pattern]


def _shared(df: DataFrame, path: str) -> str:
    """The file goes to every executor through Spark; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the array of token ids of ``column``, which goes."""
    name, kept = _shared(docs, path), [c for c in docs.columns if c not in (column, "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name, pattern)
        for batch, texts in slices(batches, column):
            ids = bpe.encode([t.decode("utf-8", "replace") for t in texts])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists], [*kept, "ids"])

    return docs.select(*kept, text_of(column).alias(column)).mapInArrow(run, f"{_schema(docs, kept)}ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``coded`` with ``decoded``, the bytes of ``ids``; null ids have null bytes."""
    name, kept = _shared(coded, path), [c for c in coded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name, pattern)
        for whole in batches:
            lengths = whole.column(whole.schema.get_field_index("ids")).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            # Runs of rows with about PART ids.
            edges = np.flatnonzero(np.diff(np.cumsum(lengths) // PART, prepend=0)).tolist()
            for start, stop in itertools.pairwise(dict.fromkeys([0, *edges, whole.num_rows])):
                batch = whole.slice(start, stop - start)
                texts = [None if x.values is None else bpe.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(batch.schema.get_field_index("ids"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return coded.select(*kept).mapInArrow(run, f"{_schema(coded, kept)}decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again."""
    coded = encode(docs.select("doc_id", "text"), path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    coded = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
    return decode(coded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
