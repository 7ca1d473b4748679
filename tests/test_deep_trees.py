"""Trees deeper than a recursive query may go."""

from witloom.operators import tree


def test_deep_tree(spark):
    depth = 100
    edges = [("t", 2 * k, k, k + 1, 1.0) for k in range(depth)] + [("t", 2 * k + 1, k, 1000 + k, 2.0) for k in range(depth)]
    labels = [(1000 + k, f"W{k}") for k in range(depth)] + [(depth, "end")]
    nodes = spark.createDataFrame([("t", k, None) for k in range(depth)] + [("t", k, s) for k, s in labels], "tree_id string, node_id int, label string")
    frame = spark.createDataFrame(edges, "tree_id string, edge_ord int, source int, target int, length double")
    rows = {(r["ancestor"], r["node"]): (r["edges"], r["length"]) for r in tree.closure(frame).collect()}
    assert rows[0, depth] == (depth, float(depth)) and rows[0, 1099] == (depth, depth + 1.0) and rows[7, 7] == (0, 0.0)
    assert len(rows) == tree.closure(frame).count() == sum(k + 1 for k in range(depth + 1)) + sum(k + 2 for k in range(depth))
    assert {r["node_id"]: r["level"] for r in tree.tree_levels(nodes, frame).collect()}[0] == depth
