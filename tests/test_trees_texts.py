"""Trees, texts, alignment, sources and sinks on literal inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from witloom.functions import normalise, translit
from witloom.operators import align, tree
from witloom.sources import editions, readers, writers


def col(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


# --- trees ---


def balanced(spark):
    nodes = spark.createDataFrame([("t", i, s, i == 1) for i, s in ((1, None), (2, None), (3, None), (4, "A"), (5, "B"), (6, "C"), (7, "D"))], "tree_id string, node_id int, label string, is_root boolean")
    edges = spark.createDataFrame([("t", k, k // 2, k, float(k)) for k in range(2, 8)], "tree_id string, edge_ord int, source int, target int, length double")
    return nodes, edges


def test_paths(spark):
    nodes, edges = balanced(spark)
    got = {(r["a"], r["b"]): (r["edges"], r["length"]) for r in tree.tree_paths(nodes, edges).collect()}
    assert got[("A", "B")] == (2, 9.0) and got[("A", "D")] == (4, 4 + 2 + 3 + 7.0) and len(got) == 6
    assert [r["diameter"] for r in tree.tree_diameter(tree.tree_paths(nodes, edges)).collect()] == [4]
    assert {r["node_id"]: r["level"] for r in tree.tree_levels(nodes, edges).collect()} == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}


def test_reroot(spark):
    nodes = spark.createDataFrame([("t", x, x if x in "ABCD" else None, x == "r") for x in "rnABCD"], "tree_id string, node_id string, label string, is_root boolean")
    edges = spark.createDataFrame([("t", 1, "r", "A", 1.0), ("t", 2, "r", "n", 2.0), ("t", 3, "r", "B", 1.0), ("t", 4, "n", "C", 1.0), ("t", 5, "n", "D", 1.0)], "tree_id string, edge_ord int, source string, target string, length double")
    new_nodes, new_edges = tree.tree_reroot(nodes, edges)
    assert {(r["source"], r["target"], r["length"]) for r in new_edges.collect()} == {("r", "A", 1.0), ("fakeroot", "n", 2.0), ("r", "B", 1.0), ("n", "C", 1.0), ("n", "D", 1.0), ("fakeroot", "r", 0.0)}
    assert [r["node_id"] for r in new_nodes.where("is_root").collect()] == ["fakeroot"]


def test_fitch(spark):
    nodes, edges = balanced(spark)
    # Column 0: a conflict that the down-pass resolves; 1: a missing witness; 2: a tie at the root; 3: an empty reading.
    readings = {"A": ["x", "x", "p", ""], "B": ["y", "y", "p", "q"], "C": ["x", None, "s", ""], "D": ["x", "y", "s", ""]}
    cells = spark.createDataFrame([("p", s, k, n, r) for k, (s, rs) in enumerate(readings.items()) for n, r in enumerate(rs) if r is not None], "passage_id string, siglum string, wit_ord int, n int, reading string")
    solved = tree.fitch(cells, nodes, edges)
    got = {(r["n"], r["node_id"]): r["reading"] for r in tree.reconstruct_all(solved).collect()}
    assert got[(0, "1")] == "x" and got[(0, "2")] == "x" and got[(0, "3")] == "x"
    assert got[(1, "1")] == "y" and got[(1, "2")] == "y" and got[(1, "3")] == "y"
    assert got[(2, "1")] == "{p, s}" and got[(3, "2")] == "_"
    row = {r["n"]: r["reading"] for r in tree.reconstruct_node(cells, solved, 2, "ω").collect()}
    assert row == {0: "x", 1: "y", 2: "p", 3: ""}
    up = {(r["n"], r["node_id"]): r["states"] for r in tree.node_states(solved, "up").collect()}
    assert up[(0, "2")] == ["x", "y"] and all(up.values())


def test_spread(spark):
    nodes, edges = balanced(spark)
    cells = spark.createDataFrame([("p", s, k, n, r) for n, rs in enumerate(("aabb", "abba", "aaab")) for k, (s, r) in enumerate(zip("ABCD", rs, strict=True))], "passage_id string, siglum string, wit_ord int, n int, reading string")
    got = {(r["n"], r["reading"]): (r["spread"], r["ratio"]) for r in tree.variant_spread(cells, tree.tree_paths(nodes, edges).drop("tree_id")).collect()}
    assert got == {(0, "a"): (2, 0.5), (0, "b"): (2, 0.5), (1, "a"): (4, 1.0), (1, "b"): (4, 1.0), (2, "a"): (4, 1.0), (2, "b"): (0, 0.25)}


# --- texts ---


def test_roman(spark):
    assert col(spark, "ātmā vastu svabhāvaś ca", translit.iast_to_slp1) == "AtmA vastu svaBAvaS ca"
    assert col(spark, "AtmA vastu svaBAvaS ca", translit.slp1_to_iast) == "ātmā vastu svabhāvaś ca"
    assert col(spark, "khai  ja", lambda t: translit.split_glyphs(t, translit.IAST)) == ["kh", "ai  ", "j", "a"]
    assert col(spark, "tac ca tattvaM", translit.split_aksaras) == ["ta", "c", " ", "ca", " ", "ta", "ttvaM"]
    assert col(spark, " a  bc d ", translit.split_words) == [" ", "a  ", "bc ", "d "]
    assert col(spark, " Śiva's ", translit.nexus_reading) == "ziva()s"


def test_scripts(spark):
    assert [col(spark, t, translit.detect_script) for t in ("abc", "क a", "అ", "അ", "அ क", "অ")] == ["iast", "devanagari", "telugu", "malayalam", "tamil", "bengali"]
    assert col(spark, "धर्मः", lambda t: translit.indic_to_roman(t, "devanagari")) == "dharmaḥ"
    assert col(spark, "dharmaḥ", lambda t: translit.roman_to_indic(t, "devanagari")) == "धर्मः"
    for script in ("devanagari", "telugu", "bengali"):
        there = lambda t, s=script: translit.indic_to_roman(translit.roman_to_indic(t, s), s)
        assert col(spark, "śāstrārtho vivekaḥ", there) == "śāstrārtho vivekaḥ"


def test_normalising_keeps_the_spelling(spark):
    rnd = random.Random(3)
    glyphs = [g for g in translit.all_glyphs(translit.IAST) if len(g) < 3] + list("      ||.,'-1ẽ")
    texts = ["".join(rnd.choice(glyphs) for _ in range(rnd.randint(0, 120))) for _ in range(40)] + ["", " ", "||", "śarīran tatvam", "|| tac ca nityam || 1 ||"]
    wits = spark.createDataFrame([("p", f"W{i}", i, t) for i, t in enumerate(texts)], "passage_id string, siglum string, wit_ord int, seq string")
    for unit, spaces in (("glyph", normalise.REMOVE_SPACES), ("word", normalise.COLLAPSE_SPACES)):
        plain = wits.select("siglum", translit.iast_to_slp1(F.col("seq")).alias("slp"), normalise.normalise_text(translit.iast_to_slp1(F.col("seq")), spaces=spaces).alias("norm"))
        both = normalise.normalise_tokens(wits, unit).join(plain, "siglum").collect()
        for r in both:
            assert "".join(t["surface"] for t in r["toks"]) == r["slp"]
            assert "".join(t["norm"] for t in r["toks"]) == r["norm"], (r["slp"], r["norm"])


def test_renormalised_cells():
    assert normalise.renormalise(["a", "r", "t", "th", "ī ", "'"]) == ["a", "r", "th", "", "ī", "a"]  # the match's first cell keeps what fits there
    assert normalise.renormalise(["pārttho ", "gacchati"]) == ["pārthaḥ", "gacchati"]
    assert normalise.renormalise([]) == [] and normalise.renormalise(["", "||"]) == ["", ""]
    for cells in (["tac ", "ca"], ["o", " ka"], ["k", "", "ṣ", "a"]):
        assert len(normalise.renormalise(cells)) == len(cells)
    assert normalise.renormalise(["ē", "m", "t"], tamil=True)[0] == "e"


# --- alignment ---


def brute_score(a, b, m):
    low = -1e18
    best = {(0, 0): (0.0, low, low)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                x = max(best[i - 1, j - 1]) + (m.match if a[i - 1] == b[j - 1] else m.mismatch) if i and j else low
                d = max(best[i - 1, j][0] + m.gap_open, best[i - 1, j][1] + m.gap_extend, best[i - 1, j][2] + m.gap_open) if i else low
                s = max(best[i, j - 1][0] + m.gap_open, best[i, j - 1][1] + m.gap_open, best[i, j - 1][2] + m.gap_extend) if j else low
                best[i, j] = (x, d, s)
    return max(best[len(a), len(b)])


def test_aligner_matches_brute_force():
    rnd, m = random.Random(2), align.ScoreModel()
    pairs = [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))) for _ in range(80)] + [("", ""), ("abc", ""), ("", "a")]
    codes = lambda t: np.array([ord(c) - 96 for c in t], np.int64)
    scores = np.full((5, 5), m.mismatch)
    np.fill_diagonal(scores, m.match)
    for (a, b), (score, trace) in zip(pairs, align.align_batch([codes(a) for a, _ in pairs], [codes(b) for _, b in pairs], scores, m), strict=True):
        assert abs(score - brute_score(a, b, m)) < 1e-9
        assert trace.count("M") + trace.count("D") == len(a) and trace.count("M") + trace.count("I") == len(b)


def test_star(spark):
    texts = ["kāṃḍa", "ka", "kaṃḍaka", "", "ka"]
    toks = spark.createDataFrame([("p", f"W{i}", i, list(t)) for i, t in enumerate(texts)], "passage_id string, siglum string, wit_ord int, toks array<string>")
    pairs = align.pairwise_align(toks)
    assert pairs.count() == 10
    merged = align.star_merge(toks, pairs, align.center_witness(pairs)).collect()
    width = max(r["n"] for r in merged) + 1
    for i, t in enumerate(texts):
        mine = sorted((r["n"], r["reading"], r["pos"]) for r in merged if r["siglum"] == f"W{i}")
        assert [n for n, _, _ in mine] == list(range(width)) and "".join(x for _, x, _ in mine) == t
        assert [p for _, _, p in mine if p is not None] == list(range(len(t)))


def test_token_scores(spark):
    pairs = spark.createDataFrame([("ka", "ka", ["k", "a"], ["k", "a"]), ("ka", "kA", ["k", "a"], ["k", "A"])], "a string, b string, a_glyphs array<string>, b_glyphs array<string>")
    assert {(r["a"], r["b"]): r["score"] for r in align.token_pair_score(pairs).collect()} == {("ka", "ka"): 1.0, ("ka", "kA"): 0.0}


# --- sources and sinks ---


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "v1.fas").write_text(">A one\nka\nla\n>GV\n\n>B\r\nm\r\n")
    got = sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "v1.fas")).collect())
    assert got == [("v1", "A one", 0, "kala"), ("v1", "B", 2, "m"), ("v1", "GV", 1, "")]
    cells = spark.createDataFrame([("p", "A", 0, 0, 'x "q", y', None), ("p", "A", 0, 1, "", None), ("p", "B", 1, 0, " <a> & b ", "l"), ("p", "B", 1, 1, "007", None)], "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string")
    want = sorted((r["siglum"], r["n"], r["reading"]) for r in cells.collect())
    for texts, parse in ((writers.alignment_csv(cells), readers.parse_alignment_csv), (writers.tei_matrix(cells), readers.parse_tei_matrix)):
        back = parse(texts.withColumnRenamed("passage_id", "path"))
        assert sorted((r["siglum"], r["n"], r["reading"]) for r in back.collect()) == want
    (tmp_path / "a.csv").write_text('A, 01 ,"b ""c"" ",,\nB,x,y,z\n')
    assert sorted(tuple(r)[1:] for r in readers.read_alignment_csv(spark, str(tmp_path / "a.csv")).collect()) == [("A", 0, 0, "01"), ("A", 0, 1, 'b "c" '), ("A", 0, 2, ""), ("B", 1, 0, "x"), ("B", 1, 1, "y"), ("B", 1, 2, "z")]


def test_trees_and_matrices(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<nexml xmlns="http://www.nexml.org/2009"><trees><tree id="t1"><node id="n1" root="true"/><node id="n2" label="A" otu="o1"/><edge id="e1" source="n1" target="n2" length="-0.5"/></tree></trees></nexml>')
    nodes, edges = readers.read_trees(spark, str(tmp_path / "t.xml"))
    assert sorted((r["node_id"], r["is_root"]) for r in nodes.collect()) == [("n1", True), ("n2", False)]
    assert [(r["source"], r["target"], r["length"]) for r in edges.collect()] == [("n1", "n2", -0.5)]
    (tmp_path / "m.csv").write_text(";ā;kh\nā;1;-1.25\nkh;-1.25;1\n")
    assert {(r["a"], r["b"]): r["score"] for r in readers.read_subst_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("A", "A"): 1.0, ("A", "K"): -1.25, ("K", "A"): -1.25, ("K", "K"): 1.0}


EDITION = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><idno type="siglum">Ed</idno><listWit><witness xml:id="A"/><witness xml:id="B"/></listWit></teiHeader>
<text><p xml:id="p1">one <app><lem wit="#A">two</lem><rdg wit="#B">zwei</rdg></app><note>no</note> three <app><rdg wit="#A">x</rdg></app>
 <corr>c</corr>end</p></text></TEI>"""


def test_editions(spark):
    parsed = editions.segments(spark.createDataFrame([("d", EDITION)], "path string, value string"))
    texts = {r["siglum"]: r["text"] for r in editions.variant_texts(parsed).collect()}
    assert texts == {"A": "one two three x end", "B": "one zwei three end"}
    assert editions.passage_select(parsed, spark.createDataFrame([("p2",)], "passage_id string")).count() == 0
    plain = editions.policy_text(spark.createDataFrame([(1, EDITION), (2, None)], "id int, x string"), "x")
    assert {r["id"]: r["x"] for r in plain.collect()} == {1: "Ed one two three end", 2: ""}


def test_stream(spark, tmp_path):
    from witloom.streaming.texts import normalised_witnesses

    wits = spark.createDataFrame([("p", "A", "tac ca"), ("p", "B", "क")], "passage_id string, siglum string, seq string")
    wits.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(wits.schema).parquet(str(tmp_path / "in"))
    query = normalised_witnesses(stream).writeStream.format("memory").queryName("norms").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("norms").collect())) == sorted(map(tuple, normalised_witnesses(wits).collect()))


def test_sites_keep_order(spark):
    nodes, edges = balanced(spark)
    cells = spark.createDataFrame([("p", s, k, 0, r) for k, (s, r) in enumerate(zip("ABD", ["b", "a", "a"], strict=True))], "passage_id string, siglum string, wit_ord int, n int, reading string")
    r = tree.fitch(cells, nodes, edges).first()
    assert r["up"] == {"1": ["a"], "2": ["b", "a"], "3": ["a"]} and r["down"]["2"] == ["a"] and sorted(r["agreed"]) == ["1"]


def plain_fitch(site, children, root):
    """Both passes by recursion, for one tree and one site (readings by leaf)."""
    up, down = {}, {}

    def rise(node):
        if node not in children:
            up[node] = [site[node]] if site.get(node) is not None else []
            return
        for c in children[node]:
            rise(c)
        sets = [up[c] for c in children[node]]
        up[node] = [x for x in sets[0] if all(x in s for s in sets)] or list(dict.fromkeys(x for s in sets for x in s))

    def fall(node, above):
        own = up[node]
        down[node] = own if above is None or len(own) == 1 else [x for x in above if x in own] or own
        for c in children[node]:
            if c in children:
                fall(c, down[node])

    rise(root)
    fall(root, None)
    return {str(n): up[n] for n in children}, {str(n): down[n] for n in children}


def test_several_trees(spark):
    """Random trees of any number of children, one of 70 levels, against the recursion; no Python in the plan."""
    rnd = random.Random(9)
    trees, cells = {}, []
    for t in range(5):
        children, open_, k = {}, [0], 1
        while open_ and len(children) < (70 if t == 4 else 8):
            node = open_.pop(0)
            kids = list(range(k, k + (2 if t == 4 else rnd.randint(2, 4))))
            children[node], k = kids, kids[-1] + 1
            open_ += kids[:1] if t == 4 else kids
        leaves = [c for kids in children.values() for c in kids if c not in children]
        trees[f"t{t}"] = (children, leaves)
        for n in range(4):
            cells += [(f"t{t}", "p", f"L{x}", x, n, rnd.choice(["a", "b", "", "c "])) for x in leaves if rnd.random() < 0.9]
    nodes = [(t, x, f"L{x}" if x in leaves else None, x == 0) for t, (children, leaves) in trees.items() for x in [*children, *leaves]]
    edges = [(t, x, p, x, 1.0) for t, (children, _) in trees.items() for p, kids in children.items() for x in kids]
    frame = spark.createDataFrame(cells, "tree_id string, passage_id string, siglum string, wit_ord int, n int, reading string")
    solved = tree.fitch(frame, spark.createDataFrame(nodes, "tree_id string, node_id int, label string, is_root boolean"), spark.createDataFrame(edges, "tree_id string, edge_ord int, source int, target int, length double"))
    assert "InArrow" not in solved._jdf.queryExecution().toString() and "Python" not in solved._jdf.queryExecution().toString()
    got = {(r["tree_id"], r["n"]): (r["up"], r["down"]) for r in solved.collect()}
    assert len(got) == 20
    for (t, n), maps in got.items():
        site = {x: r for u, _, _, x, m, r in cells if (u, m) == (t, n)}
        assert maps == plain_fitch(site, trees[t][0], 0), (t, n)
