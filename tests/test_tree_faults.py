"""Malformed trees are reported instead of walked; sound ones beside them keep their rows; several trees have their own diameters."""

from witloom.operators import tree

EDGES = "tree_id string, edge_ord int, source int, target int, length double"


def forest(spark):
    edges = [("loop", 1, 1, 2, 0.1), ("loop", 2, 2, 1, 0.1), ("self", 1, 1, 1, 0.1), ("dag", 1, 1, 3, 0.1), ("dag", 2, 2, 3, 0.1), ("dag", 3, 0, 1, 0.1), ("dag", 4, 0, 2, 0.1)]
    edges += [("ring", k, k, (k + 1) % 11, 0.1) for k in range(11)] + [("ring", 20, 3, 50, 0.1)]
    edges += [("good", 1, 1, 2, 0.5), ("good", 2, 1, 3, 0.25), ("good", 3, 3, 4, 0.25), ("good", 4, 3, 5, 0.125)]
    # Uneven: a spine of 70 inner nodes, each with a leaf.
    edges += [("spine", k, k, k + 1, 1.0) for k in range(70)] + [("spine", 100 + k, k, 1000 + k, 1.0) for k in range(71)]
    nodes = [("good", n, f"W{n}" if n in (2, 4, 5) else None, n == 1) for n in range(1, 6)]
    nodes += [("spine", n, None, n == 0) for n in range(71)] + [("spine", 1000 + n, f"W{n}", False) for n in range(71)] + [("loop", 1, "W1", True), ("loop", 2, "W2", False)]
    return spark.createDataFrame(nodes, "tree_id string, node_id int, label string, is_root boolean"), spark.createDataFrame(edges, EDGES)


def test_faults_and_rows(spark):
    nodes, edges = forest(spark)
    assert {tuple(r) for r in tree.tree_faults(edges).collect()} == {("loop", "cycle"), ("self", "cycle"), ("ring", "cycle"), ("dag", "second parent")}
    assert {r["tree_id"] for r in tree.closure(edges).select("tree_id").distinct().collect()} == {"good", "spine"}
    paths = tree.tree_paths(nodes, edges)
    got = {(r["tree_id"], r["a"], r["b"]): (r["edges"], r["length"]) for r in paths.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "good"} == {("W2", "W4"): (3, 1.0), ("W2", "W5"): (3, 0.875), ("W4", "W5"): (2, 0.375)}
    assert len(got) == 3 + 71 * 70 // 2 and all(v[0] == abs(int(k[1][1:]) - int(k[2][1:])) + 2 for k, v in got.items() if k[0] == "spine")
    assert {tuple(r) for r in tree.tree_diameter(paths).collect()} == {("good", 3), ("spine", 72)}
    assert tree.closure(edges.where("tree_id = 'none'")).count() == 0


def test_spread_by_tree(spark):
    nodes, edges = forest(spark)
    cells = spark.createDataFrame([("p", 0, "W2", "x"), ("p", 0, "W4", "x"), ("p", 0, "W5", "y"), ("p", 0, "W60", "x")], "passage_id string, n int, siglum string, reading string")
    got = {(r["tree_id"], r["reading"]): (r["witnesses"], r["spread"], r["branch"], r["ratio"]) for r in tree.variant_spread(cells, tree.tree_paths(nodes, edges)).collect()}
    assert got == {("good", "x"): (2, 3, 1.0, 1.0), ("good", "y"): (1, 0, 0.0, 0.333333), ("spine", "x"): (3, 60, 60.0, 0.833333), ("spine", "y"): (1, 0, 0.0, 0.013889)}
