"""One walk over each tree: order, depths, heights, faults, and where neighbouring taxa meet.

A tree is one row of a task (its nodes and edges, not its pairs), so memory is bounded by a batch of trees. What needs pairs
of taxa is worked out later, in blocks that Spark deals out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Taxa of one row of the pairs' work; each such row carries the tree's taxa.
BLOCK = 256
#: Pairs of one Arrow batch that a task gives back.
BATCH = 100_000


def steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a node of every sound tree; one row with ``fault`` and nothing else for the others.

    tree_id, node, label, place (preorder, from 0), depth, length and unknown (edges, branch length and edges without a length
    from the root), height (longest way down), level (the same to a labelled node; null without one), meet and meet_depth,
    meet_length, meet_unknown (for a labelled node: the lowest common ancestor with the labelled node before it in preorder; its place, or
    -1 if they share no root), fault (``second parent``, also for an edge that stands twice, or ``cycle``).

    Edges without both ends don't count; a node listed twice counts once, with its least label; nodes without edges have no row;
    an empty table gives no rows. Several roots of one tree_id are walked one after the other.
    """
    kind = edges.schema["target"].dataType
    tree = edges.schema["tree_id"].dataType
    ends = edges.select("tree_id", F.col("source").cast(kind).alias("source"), "target", F.col("length").cast("double").alias("length")).where("source IS NOT NULL AND target IS NOT NULL")
    named = nodes.where("label IS NOT NULL").select(F.col("tree_id").cast(tree).alias("tree_id"), F.col("node_id").cast(kind).alias("node"), F.col("label").cast("string").alias("label"))
    fields = f"tree_id {tree.simpleString()}, node {kind.simpleString()}, label string, place int, depth int, length double, unknown int, height int, level int, meet int, meet_depth int, meet_length double, meet_unknown int, fault string"
    out = COLUMNS

    # A tree is one row of lists, so a batch holds many trees: a group of its own for each costs more than its walk.
    rows = named.select("tree_id", F.struct("node", "label").alias("taxon"), F.lit(None).alias("line")).unionByName(ends.select("tree_id", F.lit(None).alias("taxon"), F.struct("source", "target", "length").alias("line")))
    trees = rows.groupBy("tree_id").agg(F.collect_list("taxon").alias("taxa"), F.collect_list("line").alias("lines")).where(F.size("lines") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = batch.schema
            node = schema.field("lines").type.value_type.field("target").type
            types = [schema.field("tree_id").type if c == "tree_id" else node if c == "node" else {"label": pa.string(), "fault": pa.string(), "length": pa.float64(), "meet_length": pa.float64()}.get(c, pa.int32()) for c in out]
            held, count = {c: [] for c in out}, 0
            for r in range(batch.num_rows):
                taxa, lines = (batch.column(c)[r].values for c in ("taxa", "lines"))
                made = walked(batch.column("tree_id")[r].as_py(), [taxa.field(c).to_pylist() for c in ("node", "label")], [lines.field(c).to_pylist() for c in ("source", "target", "length")])
                for c in out:
                    held[c] += made[c]
                count += len(made["node"])
                if count >= BATCH or r == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(held[c], t) for c, t in zip(out, types, strict=True)], out)
                    held, count = {c: [] for c in out}, 0

    return trees.mapInArrow(run, fields)


#: Columns of :func:`steps`.
COLUMNS = ["tree_id", "node", "label", "place", "depth", "length", "unknown", "height", "level", "meet", "meet_depth", "meet_length", "meet_unknown", "fault"]


def walked(tree_id: object, taxa: list[list], lines: list[list]) -> dict[str, list]:
    """The rows of :func:`steps` of one tree, column by column; ``taxa``: nodes, labels; ``lines``: sources, targets, lengths."""
    source, target, length = lines

    def fault(what: str) -> dict[str, list]:
        return {c: [None] for c in COLUMNS} | {"tree_id": [tree_id], "fault": [what]}

    if len(set(target)) < len(target):
        return fault("second parent")
    label: dict = {}
    for node, name in zip(*taxa, strict=True):
        label[node] = min(name, label.get(node, name))
    below: dict = {}
    for s, t, x in zip(source, target, length, strict=True):
        below.setdefault(s, []).append((t, x))
    order, parent, depth, dist, unknown = [], [], [], [], []
    stack = [(root, -1, 0, 0.0, 0) for root in sorted(set(source) - set(target), reverse=True)]
    while stack:
        node, above, d, x, u = stack.pop()
        place = len(order)
        for values, v in zip((order, parent, depth, dist, unknown), (node, above, d, x, u), strict=True):
            values.append(v)
        stack += [(t, place, d + 1, x + (e or 0.0), u + (e is None)) for t, e in below.get(node, ())]
    if len(order) < len(set(source) | set(target)):
        return fault("cycle")
    height, level = [0] * len(order), [0 if n in label else -1 for n in order]
    for p in range(len(order) - 1, 0, -1):
        if (up := parent[p]) >= 0:
            height[up] = max(height[up], height[p] + 1)
            level[up] = max(level[up], level[p] + 1 if level[p] >= 0 else -1)
    # From a taxon up to the first place at or before the last taxon: that node lies over both. Each place is passed once.
    meet, before = [None] * len(order), None
    for p, n in enumerate(order):
        if n in label:
            up = p
            while before is not None and up > before:
                up = parent[up]
            meet[p], before = -1 if before is None else up, p
    met = [m if m is not None and m >= 0 else None for m in meet]
    at = lambda values: [None if m is None else values[m] for m in met]
    return {
        "tree_id": [tree_id] * len(order), "node": order, "label": [label.get(n) for n in order], "place": list(range(len(order))), "depth": depth, "length": dist, "unknown": unknown,
        "height": height, "level": [None if v < 0 else v for v in level], "meet": meet, "meet_depth": at(depth), "meet_length": at(dist), "meet_unknown": at(unknown), "fault": [None] * len(order),
    }


def taxon_pairs(walked: DataFrame) -> DataFrame:
    """tree_id, a, b, edges, length for any two labels a < b of a tree that share a root; length is null if an edge on the way has none.

    In preorder the lowest common ancestor of two taxa is the least meeting place between them, so a taxon's paths to all others
    are running minima: no table of ancestors, one step a pair whatever the depth. A row of work is BLOCK labels of a tree. Of a label that
    stands at several nodes the nearest counts (then the shortest).
    """
    item = F.struct("place", "label", "depth", "length", "unknown", "meet", *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("meet_depth", "int"), ("meet_length", "double"), ("meet_unknown", "int"))))
    taxa = walked.where("label IS NOT NULL").groupBy("tree_id").agg(F.sort_array(F.collect_list(item)).alias("taxa"))
    names = ("label", "depth", "length", "unknown", "meet", "meet_depth", "meet_length", "meet_unknown")
    packed = taxa.select("tree_id", *(F.col(f"taxa.{c}").alias(c) for c in names))
    blocks = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.size("label") - 1, F.lit(BLOCK))))
    # A fixed number of parts: a block's work is its pairs, which the size of its row doesn't tell.
    parts = int(walked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "tree_id", "first")
    tree = walked.schema["tree_id"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, held, waiting = batch.schema.field("tree_id").type, [], 0
            for r in range(batch.num_rows):
                first, tree_id = batch.column("first")[r].as_py(), batch.column("tree_id")[r].as_py()
                values = {c: batch.column(c)[r].values for c in names}
                for one, found in block_pairs(values["label"].to_pylist(), {c: values[c].to_numpy(zero_copy_only=False) for c in names[1:]}, first):
                    held.append((tree_id, one, *found))
                    waiting += len(found[0])
                    if waiting >= BATCH:
                        yield made(kind, held)
                        held, waiting = [], 0
            if waiting:
                yield made(kind, held)

    return dealt.mapInArrow(pairs, f"tree_id {tree}, a string, b string, edges int, length double")


def made(kind: pa.DataType, held: list) -> pa.RecordBatch:
    others, edges, length, known = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5))
    row = pa.array(np.repeat(np.arange(len(held)), [len(h[2]) for h in held]))
    columns = [pa.array([h[0] for h in held], kind).take(row), pa.array([h[1] for h in held], pa.string()).take(row), pa.array(others, pa.string()), pa.array(edges, pa.int32()), pa.array(length, pa.float64(), mask=~known)]
    return pa.RecordBatch.from_arrays(columns, ["tree_id", "a", "b", "edges", "length"])


def block_pairs(labels: list[str], taxa: dict[str, np.ndarray], first: int) -> Iterator[tuple[str, tuple]]:
    """(label, (greater labels, edges, lengths, known)) for the BLOCK labels from ``first`` on, of the sorted distinct ones."""
    names = np.array(labels, dtype=object)
    distinct = sorted(set(labels))
    rank = {name: k for k, name in enumerate(distinct)}
    of = np.array([rank[name] for name in labels])
    repeated = len(distinct) < len(labels)
    depth, length, unknown, meet = taxa["depth"], taxa["length"], taxa["unknown"], taxa["meet"]
    places, at = np.unique(meet, return_index=True)
    # The first taxon meets none (-1), as do taxa of another root.
    met = {c: taxa[f"meet_{c}"][at] for c in ("depth", "length", "unknown")}
    where = np.argsort(of, kind="stable")
    for k in range(first, min(first + BLOCK, len(distinct))):
        best = None
        for i in where[np.searchsorted(of[where], k) : np.searchsorted(of[where], k, side="right")]:
            lowest = np.empty(len(labels), meet.dtype)
            lowest[i + 1 :] = np.minimum.accumulate(meet[i + 1 :])
            lowest[:i] = np.minimum.accumulate(meet[i:0:-1])[::-1]
            lowest[i] = -1
            use = np.flatnonzero((of > k) & (lowest >= 0))
            over = np.searchsorted(places, lowest[use])
            edges = depth[i] + depth[use] - 2 * met["depth"][over]
            way = length[i] + length[use] - 2 * met["length"][over]
            known = unknown[i] + unknown[use] - 2 * met["unknown"][over] == 0
            found = (use, edges, way, known)
            best = found if best is None else tuple(np.concatenate(x) for x in zip(best, found))
        use, edges, way, known = best
        if repeated:
            order = np.lexsort((way, ~known, edges, of[use]))
            order = order[np.unique(of[use][order], return_index=True)[1]]
            use, edges, way, known = use[order], edges[order], way[order], known[order]
        yield distinct[k], (names[use], edges.astype(np.int32), way, known)
