from witloom.operators import tree


def test_states_are_not_sent_to_all_tasks(spark):
    """State sets of 2,000 columns, half of them alike, meet their columns in a sorted join on two hashes: a broadcast of them took the driver's memory."""
    nodes = spark.createDataFrame([("t", 1, None, True), ("t", 2, "A", False), ("t", 3, "B", False)], "tree_id string, node_id int, label string, is_root boolean")
    edges = spark.createDataFrame([("t", 2, 1, 2, 1.0), ("t", 3, 1, 3, 1.0)], "tree_id string, edge_ord int, source int, target int, length double")
    reading = lambda s, n: "x" if n % 2 else f"{s}{n % 50}" if n % 4 else ""
    cells = spark.createDataFrame([("p", s, k, n, reading(s, n)) for n in range(2000) for k, s in enumerate("AB")], "passage_id string, siglum string, wit_ord int, n int, reading string")
    solved = tree.fitch(cells, nodes, edges)
    plan = solved._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [site_1" in plan
    assert not [line for line in plan.split("\n") if "BroadcastHashJoin [site" in line and "Inner" in line]
    got = {r["n"]: (r["up"]["1"], r["down"]["1"], r["agreed"]) for r in solved.collect()}
    assert len(got) == 2000
    for n, (up, down, agreed) in got.items():
        a, b = reading("A", n), reading("B", n)
        assert up == down == ([a] if a == b else [a, b]) and agreed == (["1"] if a == b else []), n
