"""Spread by two sweeps against all pairs, on random uneven trees with equal and zero branch lengths."""

import random
from itertools import combinations

from witloom.operators import tree


def test_spread_equals_all_pairs(spark):
    rnd = random.Random(4)
    nodes, edges, far = [], [], {}
    for t in range(4):
        parent, length = {}, {}
        for k in range(1, 60):
            parent[k], length[k] = rnd.randrange(max(0, k - 2 - 6 * t), k), rnd.choice((0.0, 0.25, 0.25, 0.5, 2.0))
        leaves = [k for k in range(60) if k not in parent.values()]
        up = {k: [k] for k in range(60)}
        for k in range(1, 60):
            up[k] = [k, *up[parent[k]]]
        for a, b in combinations(leaves, 2):
            way = set(up[a]) ^ set(up[b])
            far[t, f"W{a}", f"W{b}"] = far[t, f"W{b}", f"W{a}"] = (len(way), sum(length[k] for k in way))
        nodes += [(str(t), k, f"W{k}" if k in leaves else None, k == 0) for k in range(60)]
        edges += [(str(t), k, parent[k], k, length[k]) for k in parent]
    cells = {("p", n, f"W{w}"): rnd.choice("abc"[: 1 + n % 3]) for n in range(12) for w in rnd.sample(range(60), 5 + 4 * n)}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "passage_id string, n int, siglum string, reading string")
    paths = tree.tree_paths(spark.createDataFrame(nodes, "tree_id string, node_id int, label string, is_root boolean"), spark.createDataFrame(edges, "tree_id string, edge_ord int, source int, target int, length double"))
    got = {(r["tree_id"], r["n"], r["reading"]): (r["witnesses"], r["spread"], r["branch"], r["ratio"]) for r in tree.variant_spread(frame, paths).collect()}
    wanted = {}
    for t in range(4):
        taxa, diameter = {a for s, a, _ in far if s == t}, max(e for (s, _, _), (e, _) in far.items() if s == t)
        for n in range(12):
            for reading in "abc":
                wits = [w for (_, m, w), v in cells.items() if m == n and v == reading and w in taxa]
                if wits:
                    longest = max([far[t, a, b] for a, b in combinations(wits, 2)], default=(0, 0.0))
                    wanted[str(t), n, reading] = (len(wits), longest[0], round(longest[1], 6), round((longest[0] or 1) / diameter, 6))
    assert got == wanted
