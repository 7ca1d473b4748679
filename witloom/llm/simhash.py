"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints that differ in at most three bits agree in one of four 16-bit quarters at least. For each quarter the
distinct fingerprints, turned so that the quarter comes first, form a binary trie; only node pairs below the same
16-bit node can hold links. Node pairs are traversed together: children on the same side keep the error, children on
opposite sides add one, and a pair is dropped when the error passes the budget.

Small nodes are traversed inside a task (as whole arrays of node pairs, level by level). A 16-bit node with more than
``LEAF`` fingerprints is first split by Spark: its node pairs go eight levels deeper by joins on a table of node
counts until both sides together are small, and every such pair is a piece of work of its own. So no node, however
common, is one task, and no pairs of documents or of fingerprints are listed: a task returns the edges of a spanning
forest of the links it found, which lose no connection.

Defined results: null text has no words and fingerprint zero; equal texts meet as one fingerprint; a null doc_id takes
part and counts as larger than every other id (null if its whole component is null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, spread_join, stored, text_of
from .components import components
from .similar import bands, joined_groups, parities

BITS = 64
QUARTERS = 4
#: Fingerprints under one node (or on both sides of a node pair) that one task traverses at once.
LEAF = 4096
STEP = 8
#: Fingerprints of small nodes that a task holds at a time.
HELD_ROWS = 200_000


def shingle_hashes(words: list[bytes], size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of all words if they are fewer."""
    n = len(words)
    if n <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - size]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text.lower().split(), size, seed))


def majority(hashes: list[int]) -> int:
    """The bits set in over half the hashes; zero for none."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            fps = np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return run


def rotate(values: np.ndarray, bits: int) -> np.ndarray:
    bits %= 64
    return values if not bits else (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def linked_pairs(values: np.ndarray, nodes: list[np.ndarray], depth: int, budget: int, brute: int = 512):
    """Yields (i, j) arrays of linked places in ``values``.

    ``values`` is sorted inside every node; ``nodes``: arrays a_low, a_high, b_low, b_high, error, all of node pairs
    at ``depth`` (bits shared by a node's members). A pair of a node with itself has equal ranges.
    """
    a0, a1, b0, b1, error = nodes
    while len(a0):
        small = ((a1 - a0) * (b1 - b0) <= brute) | (depth >= BITS)
        if small.any():
            for chunk in np.array_split(np.flatnonzero(small), max(1, int(((a1 - a0) * (b1 - b0))[small].sum() // 4_000_000))):
                x0, y0, nx, ny = a0[chunk], b0[chunk], (a1 - a0)[chunk], (b1 - b0)[chunk]
                count = nx * ny
                pair = np.repeat(np.arange(len(chunk)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = x0[pair] + k // ny[pair], y0[pair] + k % ny[pair]
                fit = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i < j)
                yield i[fit], j[fit]
            a0, a1, b0, b1, error = (v[~small] for v in (a0, a1, b0, b1, error))
            if not len(a0):
                return
        bit = np.uint64(BITS - 1 - depth)

        def halve(low: np.ndarray, high: np.ndarray, bit: np.uint64 = bit) -> np.ndarray:
            """First place in each range whose value has the bit: ranges are sorted and share all bits above."""
            low, high = low.copy(), high.copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                one = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
                high = np.where(open_ & one, mid, high)
                low = np.where(open_ & ~one, mid + 1, low)
            return low

        am, bm = halve(a0, a1), halve(b0, b1)
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, error),
            (am, a1, bm, b1, error),
            (a0, am, bm, b1, error + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], error[~same] + 1),
        ]
        a0, a1, b0, b1, error = (np.concatenate([p[c] for p in parts]) for c in range(5))
        single = (a0 == b0) & (a1 - a0 < 2)
        keep = (a1 > a0) & (b1 > b0) & (error <= budget) & ~single
        a0, a1, b0, b1, error = (v[keep] for v in (a0, a1, b0, b1, error))
        depth += 1


class Forest:
    """Least-index labels of what is linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def _edges(values: np.ndarray, forest: Forest) -> list[pa.Array]:
    at = np.flatnonzero(forest.label != np.arange(len(values)))
    return [pa.array(values[at].view(np.int64)), pa.array(values[forest.label[at]].view(np.int64))]


def _whole_nodes(budget: int):
    """Rows (quarter, turned) of a partition, sorted by both: the links below each 16-bit node. Whole nodes go as they come."""

    def solve(q: int, values: np.ndarray) -> pa.RecordBatch:
        values = np.sort(values)
        starts = np.flatnonzero(np.concatenate([[True], values[1:] >> np.uint64(48) != values[:-1] >> np.uint64(48)]))
        ends = np.concatenate([starts[1:], [len(values)]])
        forest = Forest(len(values))
        for i, j in linked_pairs(values, [starts, ends, starts, ends, np.zeros(len(starts), np.int64)], 16, budget):
            forest.link(i, j)
        return pa.RecordBatch.from_arrays(_edges(rotate(values, 64 - 16 * q), forest), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush(ended: bool) -> Iterator[pa.RecordBatch]:
            """Solves the whole nodes held; the last one may go on in the next batch."""
            nonlocal held, rows
            quarter, turned = (np.concatenate([h[c] for h in held]) for c in range(2))
            node = turned >> np.uint64(48)
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (quarter[1:] != quarter[:-1])]))
            upto = len(turned) if ended else int(new[-1])
            for q in np.unique(quarter[:upto]).tolist():
                yield solve(q, turned[:upto][quarter[:upto] == q])
            held, rows = [(quarter[upto:], turned[upto:])], len(turned) - upto

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
                rows += b.num_rows
                if rows >= HELD_ROWS:
                    yield from flush(False)
        if rows:
            yield from flush(True)

    return run


def _node_pairs(budget: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        turned, side = t.column("turned").to_numpy().view(np.uint64), t.column("side").to_numpy()
        q, depth, error = t.column("quarter")[0].as_py(), t.column("depth")[0].as_py(), t.column("error")[0].as_py()
        a, b = np.sort(turned[side == 0]), np.sort(turned[side == 1])
        values = np.concatenate([a, b]) if len(b) else a
        ranges = [0, len(a), len(a), len(values)] if len(b) else [0, len(a), 0, len(a)]
        forest = Forest(len(values))
        for i, j in linked_pairs(values, [np.array([x]) for x in (*ranges, error)], depth, budget):
            forest.link(i, j)
        return pa.table(_edges(rotate(values, 64 - 16 * q), forest), ["a", "b"])

    return run


def _node(depth: int) -> Column:
    return F.shiftrightunsigned("turned", BITS - depth)


def split_nodes(turned: DataFrame, budget: int, leaf: int) -> DataFrame | None:
    """Links below the 16-bit nodes of ``turned`` (rows quarter, turned: only of nodes too large for one task)."""
    pairs = stored(turned.select("quarter", _node(16).alias("a")).distinct().select("quarter", "a", F.col("a").alias("b"), F.lit(0).alias("error")), "node-pairs")
    out = None
    for depth in range(16 + STEP, BITS + 1, STEP):
        counts = turned.groupBy("quarter", _node(depth).alias("node")).count()
        side = lambda s: counts.select("quarter", F.shiftrightunsigned("node", STEP).alias(s), F.col("node").alias(f"{s}_"), F.col("count").alias(f"{s}_n"))  # noqa: B023, E731
        grown = pairs.join(side("a"), ["quarter", "a"]).join(side("b"), ["quarter", "b"])
        apart = F.bit_count(F.col("a_").bitwiseAND(2**STEP - 1).bitwiseXOR(F.col("b_").bitwiseAND(2**STEP - 1)))
        grown = grown.where(F.col("error") + apart <= budget).where((F.col("a") != F.col("b")) | (F.col("a_") <= F.col("b_")))
        grown = stored(grown.select("quarter", F.col("a_").alias("a"), F.col("b_").alias("b"), (F.col("error") + apart).cast("int").alias("error"), (F.col("a_n") + F.when(F.col("a_") != F.col("b_"), F.col("b_n")).otherwise(0)).alias("n")), "node-pairs")
        done = grown.where((F.col("n") <= leaf) | F.lit(depth == BITS)).withColumn("depth", F.lit(depth))
        members = turned.withColumn("node", _node(depth))
        sides = [done.select("quarter", F.col(s).alias("node"), "a", "b", "error", "depth", F.lit(k).alias("side")).where(F.col("a") != F.col("b") if k else F.lit(True)) for k, s in enumerate("ab")]
        rows = members.join(sides[0].union(sides[1]), ["quarter", "node"])
        links = rows.groupBy("quarter", "depth", "a", "b").applyInArrow(_node_pairs(budget), "a long, b long")
        out = links if out is None else out.union(links)
        pairs = grown.where(F.col("n") > leaf).select("quarter", "a", "b", "error")
        if depth == BITS or not pairs.limit(1).count():
            break
    return out


def links(fingerprints: DataFrame, budget: int = 3, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect what links among the distinct values of column ``fp``."""
    fp = F.col("fp")
    turns = F.array(*[F.struct(F.lit(q).alias("quarter"), (F.shiftleft(fp, 16 * q).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * q)) if q else fp).alias("turned")) for q in range(QUARTERS)])
    turned = stored(fingerprints.select(F.explode(turns).alias("t")).select("t.quarter", "t.turned"), "turned")
    sizes = turned.groupBy("quarter", _node(16).alias("node")).count()
    large = stored(sizes.where(F.col("count") > leaf).select("quarter", "node"), "large-nodes")
    keyed = turned.withColumn("node", _node(16))
    some = large.limit(1).count() > 0
    rest = keyed.join(large, ["quarter", "node"], "left_anti") if some else keyed
    found = rest.repartition("quarter", "node").select("quarter", "turned").sortWithinPartitions("quarter", "turned").mapInArrow(_whole_nodes(budget), "a long, b long")
    if some:
        found = found.union(split_nodes(stored(keyed.join(large, ["quarter", "node"], "left_semi").select("quarter", "turned"), "large-turned"), budget, leaf))
    return found


def near_duplicates(docs: DataFrame, budget: int = 3, size: int = 3, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each document."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    prints = stored(text.mapInArrow(_fingerprints(size, seed), "doc_id long, fp long"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("weight"), F.count("*").alias("n")), "distinct")
    edges = stored(links(distinct.select("fp"), budget, leaf), "edges")
    found = components(edges, distinct.select(F.col("fp").alias("node"), "weight"))
    classes = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", F.nullif(F.coalesce("component", "weight"), F.lit(2**63 - 1)).alias("component_id"))
    out = spread_join(prints, stored(classes, "classes"), ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    drop(edges)
    return out


def _sketches(size: int, seed: int, words: int):
    """Key, fingerprint, hash of all words, and bands, number and parities of the shingles of ``words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            split = [t.lower().split() for t in texts]
            fps = np.array([majority(shingle_hashes(w, size, seed)) for w in split], np.uint64).view(np.int64)
            whole = np.array([xxhash.xxh64_intdigest(b" ".join(w), seed + 1) for w in split], np.uint64).view(np.int64)
            sets = [np.array(shingle_hashes(w, words, seed), np.uint64) for w in split]
            keys, (size_, odd) = [bands(s) for s in sets], zip(*[parities(s) for s in sets], strict=True)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, odd)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array(whole), lists[0], pa.array(size_, pa.int64()), lists[1]], ["row", "fp", "t", "bands", "size", "odd"])

    return run


def _shingles(text: bytes, size: int) -> list[int]:
    return shingle_hashes(text.lower().split(), size)


def representatives(docs: DataFrame, budget: int = 3, size: int = 3, seed: int = 42, leaf: int = LEAF, words: int = 5, least: float | None = None) -> DataFrame:
    """k_, b_: the key of one row of each group of near copies among ``docs`` (doc_id, text, k_, b_: the row's key).

    Fingerprints within ``budget`` bits link. With ``least``, texts that share that part of their shingles of ``words`` words
    link as well, which 64 bits can't tell (see ``similar``). The row kept is one of the least doc_id, null being the largest.
    A group is told by its least fingerprint, so groups that share ids, or have none, stay apart.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), "k_", "b_")
    key = "struct<none:boolean,doc_id:long,k_:long,b_:long>"
    if least is None:
        text = docs.select(row.alias("doc_id"), text_of().cast("binary").alias("text"))
        prints = text.mapInArrow(_fingerprints(size, seed), f"doc_id {key}, fp long")
        distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("row")), "distinct")
    else:
        text = docs.select(row.alias("row"), text_of().cast("binary").alias("text"))
        prints = text.mapInArrow(_sketches(size, seed, words), f"row {key}, fp long, t long, bands array<long>, size long, odd array<long>")
        texts = stored(prints.groupBy("fp", "t").agg(F.min("row").alias("row"), *[F.any_value(x).alias(x) for x in ("bands", "size", "odd")]), "texts")
        distinct = stored(texts.groupBy("fp").agg(F.min("row").alias("row")), "distinct")
    edges = stored(links(distinct.select("fp"), budget, leaf), "edges")
    found = components(edges, distinct.select(F.col("fp").alias("node"), F.col("fp").alias("weight")))
    groups = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "row", F.coalesce("component", "fp").alias("group"))
    if least is not None:
        groups = distinct.join(joined_groups(texts, stored(groups.select("fp", "group"), "groups"), docs, _shingles, words, least), "fp")
    return groups.groupBy("group").agg(F.min("row").alias("row")).select("row.k_", "row.b_")
