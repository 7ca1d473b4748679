"""Paths between taxa by running minima against plain walks to the root; deep, uneven, repeated and malformed input."""

import random
from itertools import product

from pyspark.sql import functions as F

from witloom.operators import tree, walk

NODES = "tree_id string, node_id int, label string"
EDGES = "tree_id string, edge_ord int, source int, target int, length double"


def test_random_forests(spark):
    rnd = random.Random(11)
    nodes, edges, wanted, levels = [], [], {}, {}
    for t in range(6):
        up, size = {}, 40
        for k in range(1, size):
            if k % 17:  # the others are roots of their own
                up[k] = (rnd.randrange(max(0, k - 3), k), rnd.choice((0.0, 0.5, 1.25, None) if t % 2 else (0.0, 0.5, 1.25)))
        names = {k: f"W{rnd.randrange(12)}" if t == 5 else f"W{k}" for k in range(size) if rnd.random() < 0.6}
        nodes += [(str(t), k, names.get(k)) for k in range(size)]
        edges += [(str(t), k, s, k, x) for k, (s, x) in up.items()]

        def way(k):
            out = [k]
            while out[-1] in up:
                out.append(up[out[-1]][0])
            return out

        linked = {k for k in range(size) if k in up or any(s == k for s, _ in up.values())}
        for i, j in product(names, names):
            a, b = way(i), way(j)
            if names[i] < names[j] and set(a) & set(b) and {i, j} <= linked:
                steps = set(a) ^ set(b)
                lengths = [up[k][1] for k in steps]
                found = (len(steps), None in lengths, 0.0 if None in lengths else sum(lengths))
                key = (str(t), names[i], names[j])
                wanted[key] = min(found, wanted.get(key, found))
        for i in names:
            for d, k in enumerate(way(i)):
                if i in linked:
                    levels[str(t), k] = max(d, levels.get((str(t), k), 0))
    rnd.shuffle(edges)
    frame, lines = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    got = {(r["tree_id"], r["a"], r["b"]): (r["edges"], r["length"]) for r in tree.tree_paths(frame, lines).collect()}
    assert got == {k: (e, None if none else x) for k, (e, none, x) in wanted.items()}
    assert {(r["tree_id"], r["node_id"]): r["level"] for r in tree.tree_levels(frame, lines).collect()} == levels
    heights = {(r["tree_id"], r["node"]): r["height"] for r in walk.steps(frame, lines).collect()}
    assert heights == {(r["tree_id"], r["ancestor"]): r["h"] for r in tree.closure(lines).groupBy("tree_id", "ancestor").agg(F.max("edges").alias("h")).collect()}


def test_caterpillar(spark):
    """5,000 taxa on a spine, 12.5 million pairs: no table of ancestors (25 million rows here), every pair once."""
    spine = spark.range(5000).select(F.lit("c").alias("tree_id"), F.col("id").cast("int").alias("k"))
    edges = spine.select("tree_id", F.col("k").alias("edge_ord"), F.col("k").alias("source"), (F.col("k") + 1).alias("target"), F.lit(1.0).alias("length"))
    edges = edges.union(spine.select("tree_id", F.col("k") + 10000, "k", F.col("k") + 10000, F.lit(0.5)))
    nodes = spine.select("tree_id", (F.col("k") + 10000).alias("node_id"), F.format_string("W%04d", "k").alias("label"))
    at = lambda c: F.substring(c, 2, 4).cast("int")
    paths = tree.tree_paths(nodes, edges)
    n, bad, longest = paths.agg(F.count("*"), F.count_if((F.col("edges") != at("b") - at("a") + 2) | (F.col("length") != at("b") - at("a") + 1)), F.max("edges")).first()
    assert (n, bad, longest) == (5000 * 4999 // 2, 0, 5001)


def test_no_rows(spark):
    nodes = spark.createDataFrame([("t", 1, "W1"), ("t", 1, "W0"), ("t", 2, None), (None, 3, "x")], NODES)
    edges = spark.createDataFrame([("t", 1, None, 1, 0.5), ("t", 2, 2, None, 0.5), ("u", 3, 4, 5, None)], EDGES)
    assert tree.tree_paths(nodes, edges).count() == 0 and tree.tree_faults(edges).count() == 0
    assert tree.tree_paths(nodes, edges.limit(0)).count() == 0 and tree.tree_levels(nodes.limit(0), edges).count() == 0
    assert {tuple(r) for r in tree.tree_faults(edges.union(edges.where("tree_id = 'u'"))).collect()} == {("u", "second parent")}
    more = edges.union(spark.createDataFrame([("t", 4, 0, 1, 1.0), ("t", 5, 0, 2, 1.0), (None, 6, 2, 3, 1.0), (None, 7, 2, 4, 1.0)], EDGES))
    labels = nodes.union(spark.createDataFrame([("t", 2, "W9"), (None, 4, "y")], NODES))
    assert {tuple(r) for r in tree.tree_paths(labels, more).collect()} == {("t", "W0", "W9", 2, 2.0), (None, "x", "y", 2, 2.0)}


def test_many_trees_are_few_batches(spark):
    """Trees don't come as a group of their own each: a thousand small ones are no grouped function of Python, and come whole."""
    ids = spark.range(1000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tree_id"))
    nodes = ids.crossJoin(spark.createDataFrame([(2, "A"), (3, "B")], "node_id int, label string"))
    edges = ids.crossJoin(spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "source int, target int, length double"))
    walked = walk.steps(nodes, edges)
    assert "CoGroup" not in walked._jdf.queryExecution().executedPlan().toString()
    assert walked.count() == 3000
    rows = walk.taxon_pairs(walked).collect()
    assert {r["tree_id"] for r in rows} == {f"t{k}" for k in range(1000)}
    assert {(r["a"], r["b"], r["edges"], r["length"]) for r in rows} == {("A", "B", 2, 0.75)} and len(rows) == 1000
