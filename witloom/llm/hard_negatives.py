"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

The anchors of a block are tied by a least spanning tree over their distances. A task reads candidates in chunks and walks the
tree: the root is scored against all of them; below, a candidate's score at the parent, plus or minus the edge's length times the
candidate's norm, bounds its score at the child (Cauchy and Schwarz). Only candidates whose bounds overlap the window of scores
that still matter are scored exactly, the others keep their bounds, which pass on to the child's own children. Bounds of a
node live until its last child is done; the child with the most nodes below comes last, so a walk holds bounds of about
log2(anchors) nodes.

Two passes read the vectors where they lie: the first finds every anchor's best ``positives`` other rows of its label, the second
the best ``negatives`` rows of other labels from ``least`` hundredths of each positive's score up to that score. Anchors go out in
blocks of bounded size, each broadcast with its tree; tasks return at most what an anchor can still use, and a ranked window
merges them. No vector is shuffled. A task's first scores come from a bounded set of shared rows that only spare work. Where
vectors lie in all directions alike, edges are as long as norms and no candidate is pruned: the work is then that of an exact search.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of other
lengths are filled with zeros; equal rows are different rows, and only the anchor's own row is no candidate of it; rows that share
an id are anchors of their own; an anchor without positives, or a positive without negatives, has no rows; scores beyond a long raise
an error; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .topk import _exact_type, _matrix

#: Anchors of a block and candidates of a chunk, at most; shared rows that give the first scores.
ANCHORS, CHUNK, SHARED = 8_192, 8_192, 2_048
#: From this share of a chunk's rows on, whole rows are scored instead of picked ones.
DENSE = 0.25


@dataclass(frozen=True)
class Mining:
    """Numbers of positives and negatives, the least score in hundredths of the positive's, and the scale of components."""

    positives: int = 5
    negatives: int = 5
    least: int = 80
    scale: int = 256


def whole_rows(vectors: DataFrame, scale: int, label) -> DataFrame:
    """row (an id of its own), vec_id, label, v (array of whole numbers): the rows that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    rows = vectors.where(good & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree over the rows of ``v``: the order of a walk (parents first, the heaviest child last), parents, edge lengths."""
    n, v = len(v), v.astype(float)
    square = (v**2).sum(axis=1)
    near, parent, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    joined = []
    at = 0
    for _ in range(n):
        joined.append(at)
        out[at] = False
        d = square + square[at] - 2 * (v @ v[at])
        closer = out & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(out, near, np.inf).argmin())
    below = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in reversed(joined[1:]):
        below[parent[i]] += below[i]
        children[parent[i]].append(i)
    order, open_ = [], [0] if n else []
    while open_:
        i = open_.pop()
        order.append(i)
        open_.extend(sorted(children[i], key=lambda c: -below[c]))
    edge = np.sqrt(((v - v[np.maximum(parent, 0)]) ** 2).sum(axis=1)) if n else np.zeros(0)
    return np.array(order, np.int64), parent, edge


@dataclass
class Block:
    """Anchors of a block with their tree, and what the second pass knows of their positives."""

    rows: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    #: Scores of the anchors' positives, highest first, per anchor (second pass).
    scores: list[np.ndarray] | None = None


class Walk:
    """What a task has found for a block's anchors, and the walk that reads a chunk of candidates."""

    def __init__(self, block: Block, mining: Mining):
        self.block, self.mining, n = block, mining, len(block.rows)
        # Best candidates: of an anchor (first pass), or of each of its positives; (score, id) with the highest score first.
        slots = [1] * n if block.scores is None else [len(s) for s in block.scores]
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * k for k in slots]
        self.keep = mining.positives if block.scores is None else mining.negatives
        # The lowest score that can still be among them; at first that of each positive's window, rounded up.
        self.floor = [np.full(k, np.iinfo(np.int64).min) for k in slots] if block.scores is None else [np.array([-(-s * mining.least // 100) for s in x.tolist()], np.int64) for x in block.scores]
        last = dict.fromkeys(range(n), -1)
        for place, i in enumerate(block.order.tolist()):
            last[int(block.parent[i])] = place
        self.last, self.scored, self.met = last, 0, 0

    def read(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        b = self.block
        width = max(v.shape[1], b.v.shape[1])
        v, q = np.pad(v, ((0, 0), (0, width - v.shape[1]))), np.pad(b.v, ((0, 0), (0, width - b.v.shape[1])))
        kind = _exact_type(q, v)
        v, q, norm = v.astype(kind), q.astype(kind), np.sqrt((v.astype(float) ** 2).sum(axis=1))
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for place, i in enumerate(b.order.tolist()):
            p = int(b.parent[i])
            same = labels == b.labels[i]
            if p < 0:
                lo = hi = None
                pick = np.ones(len(v), bool)
            else:
                reach = b.edge[i] * norm
                lo, hi = low[p] - reach, high[p] + reach
                # Doubles round the bounds by far less than this.
                slack = 1e-9 * np.maximum(np.abs(lo), np.abs(hi)) + 1e-6
                pick = self.wanted(i, same, lo - slack, hi + slack)
            count = int(np.count_nonzero(pick))
            self.scored += count
            self.met += len(v)
            if count > DENSE * len(v):
                s = v @ q[i]
                lo = hi = s.astype(float)
                self.take(i, np.flatnonzero(pick), s[pick], same, rows, ids)
            elif count:
                at = np.flatnonzero(pick)
                s = v[at] @ q[i]
                lo[at] = hi[at] = s
                self.take(i, at, s, same, rows, ids)
            if p >= 0 and self.last[p] == place:
                del low[p], high[p]
            if self.last[i] >= 0:
                low[i], high[i] = lo, hi

    def wanted(self, i: int, same: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Candidates whose bounds overlap the scores that anchor ``i`` still wants."""
        if self.block.scores is None:
            return same & (hi >= self.floor[i][0])
        if not len(self.floor[i]):
            return np.zeros(len(same), bool)
        return ~same & (hi >= self.floor[i].min()) & (lo <= self.block.scores[i][0])

    def take(self, i: int, at: np.ndarray, s: np.ndarray, same: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        s = s.astype(np.int64)
        first = self.block.scores is None
        if not len(self.floor[i]):
            return
        use = (same[at] & (rows[at] != self.block.rows[i]) if first else ~same[at] & (s <= self.block.scores[i][0])) & (s >= self.floor[i].min())
        s, found = s[use], ids[at[use]]
        if not len(s):
            return
        order = np.lexsort([found, -s])
        s, found = s[order], found[order]
        for k in range(len(self.floor[i])):
            start = 0 if first else int(np.searchsorted(-s, -self.block.scores[i][k]))
            new = slice(start, start + self.keep)
            inside = s[new] >= self.floor[i][k]
            if inside.any():
                was, whose = self.best[i][k]
                scores, whose = np.concatenate([was, s[new][inside]]), np.concatenate([whose, found[new][inside]])
                order = np.lexsort([whose, -scores])[: self.keep]
                self.best[i][k] = scores[order], whose[order]
                if len(order) == self.keep:
                    self.floor[i][k] = scores[order[-1]]

    def forget(self) -> None:
        """Keep the floors alone: rows read so far will be read again."""
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in x] for x in self.best]

    def found(self) -> list[np.ndarray]:
        """anchor row, positive's place (from 0), candidate's id, score."""
        flat = [(self.block.rows[i], k, s, w) for i, x in enumerate(self.best) for k, (s, w) in enumerate(x) if len(s)]
        sizes = [len(f[2]) for f in flat]
        join = lambda c: np.concatenate([f[c] for f in flat]) if flat else np.zeros(0, np.int64)
        return [np.repeat(np.array([f[c] for f in flat], np.int64), sizes) for c in (0, 1)] + [join(3), join(2)]


FOUND = "anchor_row long, place int, vec_id long, score long"


def _search(held, shared, mining: Mining):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                if walk is None:
                    walk = Walk(held.value, mining)
                    walk.read(*shared.value)
                    walk.forget()
                walk.read(*(part.column(c).to_numpy() for c in range(3)), _matrix(part.column(3), held.value.v.shape[1]))
        if walk is not None:
            columns = walk.found()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(columns)], ["anchor_row", "place", "vec_id", "score"])

    return run


def _trees(anchors: DataFrame) -> DataFrame:
    """Anchors (row, vec_id, label, v, block) with their place in the block, the place of their parent, the order of the walk
    and the edge's length, each block's tree made by one task."""

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        order, parent, edge = spanning_tree(_matrix(table.column("v").combine_chunks(), 0))
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        for name, values in (("place", np.arange(len(order))), ("parent", parent), ("turn", turn), ("edge", edge)):
            table = table.append_column(name, pa.array(values, pa.float64() if name == "edge" else pa.int64()))
        return table

    return anchors.groupBy("block").applyInArrow(tree, "row long, vec_id long, label long, v array<long>, block long, place long, parent long, turn long, edge double")


def mine(vectors: DataFrame, anchors_where, mining: Mining = Mining(), label=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors_where`` picks the anchors' rows; ``label``, if given, is the column that replaces the label first.
    """
    spark = vectors.sparkSession
    base = stored(whole_rows(vectors, mining.scale, F.col("label") if label is None else label), "vectors")
    n, width = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = base.orderBy(F.xxhash64("vec_id", "row")).limit(SHARED).toArrow().combine_chunks()
    sample = (*(sample.column(c).to_numpy() for c in range(3)), _matrix(sample.column(3).combine_chunks(), width)) if n else None
    shared = spark.sparkContext.broadcast(sample)
    anchors = base.where(anchors_where)
    blocks = max(1, -(-anchors.count() // ANCHORS))
    # About ANCHORS rows a block, however many anchors there are.
    anchors = stored(_trees(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))), "anchors")

    def one_pass(block: int, scores: DataFrame | None) -> DataFrame:
        t = anchors.where(F.col("block") == block)
        if scores is not None:
            t = t.join(scores, F.col("row") == F.col("anchor_row"), "left")
        t = t.orderBy("place").toArrow().combine_chunks()
        order = np.argsort(t.column("turn").to_numpy(), kind="stable")
        known = [np.array(x or [], np.int64) for x in t.column("scores").to_pylist()] if scores is not None else None
        held = Block(t.column("row").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").combine_chunks(), width), order, t.column("parent").to_numpy(), t.column("edge").to_numpy(), known)
        held = spark.sparkContext.broadcast(held)
        out = stored(base.mapInArrow(_search(held, shared, mining), FOUND), "found")
        held.unpersist()
        return out

    def best(found: DataFrame, keep: int) -> DataFrame:
        order = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    results = []
    for block in range(blocks if n else 0):
        positives = stored(best(one_pass(block, None), mining.positives).select("anchor_row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        ranked = F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
        scores = positives.groupBy("anchor_row").agg(ranked.alias("scores"))
        negatives = best(one_pass(block, scores), mining.negatives).select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        results.append(stored(positives.join(negatives, ["anchor_row", "place"]).join(anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row"), "mined"))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    mined = spark.read.schema(results[0].schema).parquet(*[r._stored_at for r in results])
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def noisy_label():
    """The label of the contract: of rows whose id 7 divides it is the next one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE_SQL = """
WITH good AS (SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * d.v[i])) AS BIGINT) AS score
      FROM good a JOIN good d ON a.rid <> d.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
