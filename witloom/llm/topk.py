"""Exact top-k inner products by block-at-a-time pruning.

Candidates are cut into shards and, within a shard, into blocks of neighbouring vectors; a block keeps the largest and
smallest value of every component. For a query, the sum over components of the larger of ``q * max`` and ``q * min``
bounds every score in the block. Blocks are read in order of falling bound; a block is scored through its forward
index (its rows of components), and reading stops once the next bound lies below the query's k-th score.

Queries go out in blocks of bounded size, each broadcast to tasks that read the vectors where they lie: no vector is
shuffled or copied. A task keeps the best k of each query over all its shards and starts from a floor, the k-th score
among a bounded set of shared vectors (a floor only spares work). It returns at most k rows a query; a ranked window
merges them. Where components are alike in all vectors (as in random ones), bounds lie above all scores and every block
is read: the work is then queries times vectors.

Defined results: vectors that are null, hold null or non-finite components take no part; scores beyond a long raise an error; vectors of other lengths are
filled with zeros; a query with no candidate has no row; equal rows are different candidates, and only the
query's own row is no candidate of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
BLOCK = 256
#: Candidates in a shard and queries in a block, at most and on average.
SHARD_ROWS = 16_384
QUERY_ROWS = 16_384
FLOOR_ROWS = 2_048
FOUND = "query_row long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row (an id of its own), vec_id, v (array of whole numbers): the vectors that take part."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] : offsets[-1]]
    return out


def _exact_type(q: np.ndarray, d: np.ndarray) -> type:
    """Doubles hold whole-number products below 2**53, longs below 2**63."""
    most = float(np.abs(q.astype(float)).sum(axis=1).max(initial=0)) * float(np.abs(d.astype(float)).max(initial=0))
    if most >= 2**63:
        raise ValueError("scores of these vectors do not fit a long")
    return np.float64 if most < 2**53 else np.int64


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    kind = _exact_type(q, d)
    return q.astype(kind) @ d.astype(kind).T


class Best:
    """The best ``k`` candidates of each query so far; ``kth`` is a score that better ones reach at least."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.kth = k, floor.astype(float).copy()
        self.who, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.queries = queries

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        who, score, ids = np.concatenate([self.who, who]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort([ids, -score, who])  # highest scores, then smallest ids
        who, score, ids = who[order], score[order], ids[order]
        starts = np.searchsorted(who, np.arange(self.queries))
        place = np.arange(len(who)) - starts[who]
        last = who[place == self.k - 1]
        kth = score[place == self.k - 1].astype(float)
        self.kth[last] = np.maximum(self.kth[last], kth - np.where(np.abs(kth) < 2**53, 0.0, 1e-9 * np.abs(kth)))
        kept = place < self.k
        self.who, self.score, self.ids = who[kept], score[kept], ids[kept]

    def meet(self, q_rows: np.ndarray, q: np.ndarray, d_rows: np.ndarray, d_ids: np.ndarray, d: np.ndarray) -> int:
        """Reads a shard; the number of query-block pairs scored."""
        if not len(d) or not len(q):
            return 0
        width = max(q.shape[1], d.shape[1])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        d = np.pad(d, ((0, 0), (0, width - d.shape[1])))
        # Neighbours in a coarse order give tight blocks: sort by the component of largest spread, then the next ones.
        spread = np.argsort(-d.std(axis=0))[:4]
        order = np.lexsort([d_ids, *[np.sign(d[:, c] - np.median(d[:, c])) for c in spread]])
        d, d_ids, d_rows = d[order], d_ids[order], d_rows[order]
        blocks = [slice(s, min(s + BLOCK, len(d))) for s in range(0, len(d), BLOCK)]
        high, low = np.array([d[b].max(axis=0) for b in blocks]).astype(float), np.array([d[b].min(axis=0) for b in blocks]).astype(float)
        kind = _exact_type(q, d)
        bounds = np.maximum(q, 0).astype(float) @ high.T + np.minimum(q, 0).astype(float) @ low.T
        if kind is np.int64:  # doubles round these bounds
            bounds += 1e-9 * np.abs(bounds)
        turns = np.argsort(-bounds, axis=1, kind="stable")
        q, d = q.astype(kind), d.astype(kind)
        scored = 0
        alive = np.arange(len(q))
        for turn in range(len(blocks)):
            alive = alive[bounds[alive, turns[alive, turn]] >= self.kth[alive]]
            if not len(alive):
                break
            hits = []
            for b in np.unique(turns[alive, turn]):
                who = alive[turns[alive, turn] == b]
                scored += len(who)
                part = blocks[b]
                s = q[who] @ d[part].T
                i, j = np.nonzero((s >= self.kth[who][:, None]) & (d_rows[part][None, :] != q_rows[who][:, None]))
                hits.append((who[i], s[i, j].astype(np.int64), d_ids[part][j]))
            if any(len(h[0]) for h in hits):
                self.add(*(np.concatenate([h[c] for h in hits]) for c in range(3)))
        return scored


def search_shard(q_rows, q_ids, q, d_rows, d_ids, d, k: int, floor) -> tuple[list[np.ndarray], int]:
    """Best k candidates of a shard for each query (columns of FOUND), and the number of query-block pairs scored."""
    best = Best(len(q), k, floor)
    scored = best.meet(q_rows, np.asarray(q).astype(np.int64), d_rows, d_ids, np.asarray(d).astype(np.int64))
    return [q_rows[best.who], q_ids[best.who], best.ids, best.score], scored


def _search(held, k: int):
    """Best candidates of a task's rows (row, vec_id, v) for the queries in ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q_ids, q, floor = held.value
        best = Best(len(q), k, floor)
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(start, SHARD_ROWS)
                best.meet(q_rows, q, part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), q.shape[1]))
        columns = (q_rows[best.who], q_ids[best.who], best.ids, best.score)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries_where, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries_where`` picks, its k best other rows."""
    spark = vectors.sparkSession
    base = stored(whole_vectors(vectors), "vectors")
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # A floor for every query from one bounded set of candidates.
    sample = base.orderBy(F.xxhash64("vec_id", "row")).limit(FLOOR_ROWS).toArrow().combine_chunks().to_batches() if n else []
    s_rows, s_vecs = (sample[0].column(0).to_numpy(), _matrix(sample[0].column(2), width)) if sample else (np.zeros(0, np.int64), np.zeros((0, width), np.int64))
    shared = spark.sparkContext.broadcast((s_rows, s_vecs))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vecs = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                q = _matrix(part.column(2), width)
                floor = np.full(len(q), -np.inf)
                if len(vecs) > k:
                    s = _products(q, np.pad(vecs, ((0, 0), (0, q.shape[1] - vecs.shape[1])))).astype(float)
                    s[part.column(0).to_numpy()[:, None] == rows[None, :]] = -np.inf
                    floor = np.partition(s, -k, axis=1)[:, -k]
                    floor -= 1e-9 * np.abs(floor)  # doubles round the largest scores
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor, pa.float64())], [*part.schema.names, "floor"])

    asked = stored(base.where(queries_where).mapInArrow(floors, "row long, vec_id long, v array<long>, floor double"), "queries")
    q_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    found = []
    for block in range(q_blocks):
        # About QUERY_ROWS rows, however many queries there are.
        t = asked.where(F.pmod(F.xxhash64("row"), F.lit(q_blocks)) == block).toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((t.column("row").to_numpy(), t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks(), width), t.column("floor").to_numpy()))
        found.append(stored(base.mapInArrow(_search(held, k), FOUND), "found"))
        held.unpersist()
    found = spark.read.schema(FOUND).parquet(*[f._stored_at for f in found])
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
