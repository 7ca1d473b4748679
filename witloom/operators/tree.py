"""Rooted trees over witnesses, ancestral readings by Fitch parsimony, and the spread of variants.

Trees are tables keyed by ``tree_id``; the cells are the large side. A column's readings are packed into one array (one
shuffle), equal columns (site patterns) are solved once, and the tree is walked inside the row by folds over its
nodes: no join per tree level touches the cells, and nothing of a tree goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .columns import pick_reading
from .stats import COLUMN
from .walk import steps, taxon_pairs


#: Rows of a witness set that holds more than one row in this many don't move in joins; at most this many sets are broadcast.
HOT_SHARE = 10_000
#: Columns of a site that holds more than one column in this many are dealt out in the join on it.
HOT_SITES = 1_000
#: Two hashes that stand for the readings of a column.
SITE = ["site_1", "site_2"]


def tree_reroot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots a tree whose root touches three edges: ``fakeroot`` goes on the first of them between internal nodes.

    The edge keeps its far end and length and now starts at ``fakeroot``, and an edge of length 0 joins that to the old root.
    """
    inner = nodes.select("tree_id", F.col("node_id").cast("string").alias("node_id"), (F.col("label").isNull()).alias("inner"))
    e = edges.select("tree_id", "edge_ord", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "length")
    root = nodes.where("is_root").select("tree_id", F.col("node_id").cast("string").alias("root"))
    touching = e.join(root, "tree_id").where("source = root OR target = root")
    three = touching.groupBy("tree_id").agg(F.count("*").alias("degree")).where("degree = 3").select("tree_id")
    end = lambda c: inner.select("tree_id", F.col("node_id").alias(c), F.col("inner").alias(f"{c}_inner"))
    both = touching.join(three, "tree_id").join(end("source"), ["tree_id", "source"]).join(end("target"), ["tree_id", "target"]).where("source_inner AND target_inner")
    first = both.groupBy("tree_id").agg(F.min_by(F.struct("edge_ord", "root"), "edge_ord").alias("f")).select("tree_id", F.col("f.edge_ord").alias("on_edge"), F.col("f.root").alias("old_root"))
    moved = e.join(first, "tree_id", "left")
    hit = F.col("edge_ord") == F.col("on_edge")
    swap = lambda c: F.when(hit & (F.col(c) == F.col("old_root")), "fakeroot").otherwise(F.col(c)).alias(c)
    new_edges = moved.select("tree_id", "edge_ord", swap("source"), swap("target"), "length").unionByName(first.select("tree_id", F.lit(0).alias("edge_ord"), F.lit("fakeroot").alias("source"), F.col("old_root").alias("target"), F.lit(0.0).alias("length")))
    old = nodes.join(first, "tree_id", "left").select("tree_id", F.col("node_id").cast("string").alias("node_id"), "label", (F.col("is_root") & F.col("old_root").isNull()).alias("is_root"))
    return old.unionByName(first.select("tree_id", F.lit("fakeroot").alias("node_id"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("is_root"))), new_edges


def second_parents(edges: DataFrame) -> DataFrame:
    """tree_id of the trees in which a node has more than one parent (or an edge stands twice)."""
    return edges.groupBy("tree_id", "target").agg(F.count("*").alias("parents")).where("parents > 1").select("tree_id").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(tree_id, ancestor, node, edges, length): every node with itself and all its ancestors, by doubling of paths.

    After k rounds ``paths`` holds all paths of 1 to 2**k edges; a round joins its longest ones with all of them. Written each
    round, so neither rows nor depth are limited. Trees with a second parent or a cycle have no rows (:func:`tree_faults` reports
    them): the first are left out at once, the others in the round in which a node becomes its own ancestor.
    """
    sound = edges.join(second_parents(edges), "tree_id", "left_anti")
    paths = stored(sound.select("tree_id", F.col("source").alias("ancestor"), F.col("target").alias("node"), F.lit(1).alias("edges"), F.col("length").cast("double").alias("length")), "paths")
    longer, reach = paths, 1
    while True:
        own = F.col("ancestor") == F.col("node")
        found, cyclic = longer.agg(F.count("*"), F.coalesce(F.max(own), F.lit(False))).first()
        if cyclic:
            bad = stored(longer.where(own).select("tree_id").distinct(), "cyclic")
            paths, longer = (x.join(bad, "tree_id", "left_anti") for x in (paths, longer))
        if not found:
            break
        paths = paths if reach == 1 else paths.unionByName(longer)
        upper = paths.where(F.col("edges") == reach).select("tree_id", "ancestor", F.col("node").alias("middle"), F.col("edges").alias("e"), F.col("length").alias("l"))
        longer = upper.join(paths.withColumnRenamed("ancestor", "middle"), ["tree_id", "middle"])
        longer, reach = stored(longer.select("tree_id", "ancestor", "node", (F.col("e") + F.col("edges")).alias("edges"), (F.col("l") + F.col("length")).alias("length")), "paths"), reach * 2
    nodes = paths.select("tree_id", "node").union(paths.select("tree_id", "ancestor")).distinct()
    return paths.unionByName(nodes.select("tree_id", F.col("node").alias("ancestor"), "node", F.lit(0).alias("edges"), F.lit(0.0).alias("length")))


def tree_faults(edges: DataFrame) -> DataFrame:
    """tree_id, fault (``second parent`` or ``cycle``) of the trees that the other operators leave out."""
    unnamed = edges.select("tree_id", F.col("target").alias("node_id"), F.lit(None).cast("string").alias("label"))
    return steps(unnamed, edges).where("fault IS NOT NULL").select("tree_id", "fault")


def tree_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node: taxa 0, others one above their highest child; nodes without a taxon below have none."""
    return steps(nodes, edges).where("level IS NOT NULL").select("tree_id", F.col("node").alias("node_id"), "level")


def tree_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges and branch length between any two taxa, by their lowest common ancestor."""
    return taxon_pairs(steps(nodes, edges))


def tree_diameter(paths: DataFrame) -> DataFrame:
    return paths.groupBy("tree_id").agg(F.max("edges").alias("diameter"))


# --- Fitch ---


def plans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """tree_id, plan: the nodes of each tree, children before parents, as (node_id, label, children, parent).

    Children (in edge order) and parent are places in the plan; nodes stand by height, the longest way down to a leaf.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    e = edges.select("tree_id", "edge_ord", text("source"), text("target"), "length")
    named = steps(nodes, e).where("fault IS NULL").select("tree_id", F.col("node").alias("node_id"), "label", "height")
    placed = stored(named.withColumn("place", F.row_number().over(Window.partitionBy("tree_id").orderBy("height", "node_id")) - 1), "places")
    at = lambda c, k: placed.select("tree_id", F.col("node_id").alias(c), F.col("place").alias(k))
    below = e.join(at("target", "child"), ["tree_id", "target"]).groupBy("tree_id", F.col("source").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("edge_ord", "child"))), lambda x: x["child"]).alias("children"))
    above = e.join(at("source", "parent"), ["tree_id", "source"]).select("tree_id", F.col("target").alias("node_id"), "parent")
    whole = placed.join(below, ["tree_id", "node_id"], "left").join(above, ["tree_id", "node_id"], "left")
    node = F.struct("place", "node_id", "label", F.coalesce("children", F.array().cast("array<int>")).alias("children"), "parent")
    return whole.groupBy("tree_id").agg(F.sort_array(F.collect_list(node)).alias("plan"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fitch(cells: DataFrame, nodes: DataFrame, edges: DataFrame, normalised: bool = False) -> DataFrame:
    """passage_id, n, tree_id, up, down, agreed for every column and tree.

    ``up`` and ``down`` map the inner nodes to their state sets after each pass, in order of first appearance; ``agreed``
    are the nodes whose children share what they have. Up: what all children share, else all that they have; a missing
    witness has no state, unlike an empty reading. Down: a single state stays; else what it shares with its parent's final
    set, else the set itself. If cells have a ``tree_id`` they are solved by that tree, else by every tree.

    A column's readings are packed into one array (one shuffle), equal columns are solved once, and a tree is walked inside
    the row: the up-pass folds its plan from leaves to root, the down-pass from root to leaves. Results go back to the columns
    by two hashes of the readings, those of a frequent site dealt over several tasks.
    """
    by = [c for c in ("tree_id",) if c in cells.columns]
    held = pick_reading(cells).withColumn("reading", F.col("picked")) if normalised else cells
    taxa = nodes.where("label IS NOT NULL").select(*by, F.col("label").alias("siglum")).distinct()
    sites = held.join(taxa, [*by, "siglum"], "left_semi").groupBy(*by, *COLUMN).agg(F.sort_array(F.collect_list(F.struct("siglum", "reading"))).alias("site"))
    # Columns carry two hashes of their site from here on; only one row a site carries the site itself.
    keys = [F.xxhash64(F.lit(k), *by, "site").alias(f"site_{k}") for k in (1, 2)]
    sites = stored(sites.select("*", *keys), "sites")
    plan = stored(plans(nodes, edges), "plans")
    kinds = sites.groupBy(*by, *SITE).agg(F.first("site").alias("site"), F.count("*").alias("held"))
    kinds = kinds.join(plan, by) if by else kinds.crossJoin(plan)
    none = F.array().cast("array<string>")
    state = lambda states, agreed: F.struct(states.alias("states"), agreed.alias("agreed"))

    def leaf(readings: Column, node: Column) -> Column:
        return _let(F.try_element_at(readings, node["label"]), lambda r: state(F.when(r.isNull(), none).otherwise(F.array(r)), F.lit(False)))

    def inner(sets: Column) -> Column:
        shared = F.aggregate(F.slice(sets, F.lit(2), F.size(sets)), F.array_distinct(F.element_at(sets, 1)), F.array_intersect)
        return _let(shared, lambda s: F.when(F.size(s) > 0, state(s, F.lit(True))).otherwise(state(F.array_distinct(F.flatten(sets)), F.lit(False))))

    def up(readings: Column) -> Column:
        def step(done: Column, node: Column) -> Column:
            own = F.when(F.size(node["children"]) == 0, leaf(readings, node)).otherwise(_let(F.transform(node["children"], lambda c: F.get(done, c)["states"]), inner))
            return F.concat(done, F.array(own))

        return F.aggregate("plan", F.array().cast("array<struct<states:array<string>,agreed:boolean>>"), step)

    def down(step_done: Column, node: Column) -> Column:
        own = F.get(F.col("ups"), node["place"])["states"]
        # Finished nodes stand in reverse order: the parent of place p at size - 1 - p.
        above = F.get(step_done, F.size("plan") - 1 - node["parent"])
        shared = F.array_intersect(above, own)
        final = F.when(node["parent"].isNull() | (F.size(own) == 1), own).otherwise(_let(shared, lambda s: F.when(F.size(s) > 0, s).otherwise(own)))
        return F.concat(step_done, F.array(final))

    # Written, as a fold's result read inside another's steps would else be worked out at every step.
    kinds = stored(kinds.withColumn("ups", _let(F.map_from_entries("site"), up)), "up-pass")
    kinds = stored(kinds.withColumn("downs", F.reverse(F.aggregate(F.reverse("plan"), F.array().cast("array<array<string>>"), down))), "down-pass")
    walked = F.filter("plan", lambda node: F.size(node["children"]) > 0)
    names = F.transform(walked, lambda node: node["node_id"])
    solved = kinds.select(
        "tree_id",
        *SITE,
        F.map_from_arrays(names, F.transform(walked, lambda node: F.get(F.col("ups"), node["place"])["states"])).alias("up"),
        F.map_from_arrays(names, F.transform(walked, lambda node: F.get("downs", node["place"]))).alias("down"),
        F.transform(F.filter(walked, lambda node: F.get(F.col("ups"), node["place"])["agreed"]), lambda node: node["node_id"]).alias("agreed"),
    )
    held_by = kinds.groupBy(*by, *SITE).agg(F.first("held").alias("held"))
    total = sites.agg(F.count("*").alias("total"))
    hot = held_by.crossJoin(F.broadcast(total)).where(F.col("held") * HOT_SITES > F.col("total"))
    hot = F.broadcast(hot.select(*by, *SITE, F.ceil(F.col("held") * HOT_SITES / F.col("total")).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64(*COLUMN), "parts"), F.lit(0)).cast("int")
    members = sites.drop("site").join(hot, [*by, *SITE], "left").withColumn("part", part)
    copies = solved.join(hot, [*by, *SITE], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    # Never sent to all tasks: the written maps are many times larger in memory than their files, which Spark goes by.
    return members.drop("parts").join(copies.drop("parts").hint("merge"), [*by, *SITE, "part"]).select(*COLUMN, "tree_id", "up", "down", "agreed")


def format_states(states: Column, blanks: bool = False) -> Column:
    """One state: itself (trimmed, and a blank stays, for a single target); more: ``{a, b}``; blanks among them ``_``; none: ``{}``."""
    shown = F.transform(states, lambda s: F.when(F.trim(s) == "", "_").otherwise(s))
    listed = F.when(F.size(shown) == 1, F.element_at(shown, 1)).otherwise(F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")))
    return listed if blanks else F.when(F.size(states) == 1, F.trim(F.element_at(states, 1))).otherwise(listed)


def node_states(solved: DataFrame, which: str) -> DataFrame:
    """The state sets of one pass as rows: passage_id, n, tree_id, node_id, states."""
    return solved.select(*COLUMN, "tree_id", F.explode(which).alias("node_id", "states"))


def reconstruct_all(solved: DataFrame) -> DataFrame:
    return node_states(solved, "down").select(*COLUMN, "tree_id", "node_id", format_states(F.col("states"), blanks=True).alias("reading"))


def reconstruct_node(cells: DataFrame, solved: DataFrame, node, siglum: str) -> DataFrame:
    """The text of one node of a tree as a witness row. A single state that the up-pass found by agreement is kept untrimmed."""
    up, down = F.element_at("up", F.lit(str(node))), F.element_at("down", F.lit(str(node)))
    reading = F.when((F.size(up) == 1) & F.array_contains("agreed", str(node)), F.element_at(up, 1)).otherwise(format_states(down))
    last = cells.groupBy("passage_id").agg((F.max("wit_ord") + 1).alias("wit_ord"))
    row = solved.select(*COLUMN, reading.alias("reading")).join(last, "passage_id")
    return row.select("passage_id", F.lit(siglum).alias("siglum"), "wit_ord", "n", "reading", F.lit("reconstructed").alias("row_type"))


def variant_spread(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """For each reading of each column the longest path between two of its witnesses, and its share of the diameter.

    Witness sets repeat over columns: each distinct set is measured once, and by two sweeps: the witness farthest from the set's first,
    then the longest path from that one. In a tree this is the longest of all, for (edges, length) too, which add up along paths and are
    ordered; so a set of k witnesses costs 2k paths and not all its pairs. Witnesses outside the tree don't count, repeated ones count once
    in a path. ``paths`` are those of one tree; with a ``tree_id`` every tree gets rows of its own, measured by its own diameter.
    """
    by = [c for c in ("tree_id",) if c in paths.columns]
    known = paths.select(*by, F.col("a").alias("siglum")).union(paths.select(*by, "b")).distinct()
    sets = cells.join(known, "siglum").groupBy(*by, *COLUMN, "reading").agg(F.sort_array(F.collect_list("siglum")).alias("wits"))
    # A set is told by 128 bits, so that only distinct sets carry their witnesses further.
    sets = stored(sets.withColumn("key", F.md5(F.concat_ws("\x1f", "wits"))).withColumn("witnesses", F.size("wits")), "sets")
    kinds = sets.groupBy(*by, "key").agg(F.first("wits").alias("wits"), F.count("*").alias("held"))
    # Paths of both directions; sides of a pair are looked up as (from, to).
    step = F.struct("edges", "length")
    both = paths.select(*by, F.col("a").alias("from"), F.col("b").alias("to"), step.alias("p")).unionByName(paths.select(*by, F.col("b").alias("from"), F.col("a").alias("to"), step.alias("p")))

    def sweep(starts: DataFrame) -> DataFrame:
        """The longest path of each set from its ``from``; sets of one witness have none."""
        reached = starts.select(*by, "key", "held", "wits", "from", F.explode(F.array_distinct("wits")).alias("to")).join(both, [*by, "from", "to"])
        return reached.groupBy(*by, "key").agg(F.first("held").alias("held"), F.first("wits").alias("wits"), F.max(F.struct("p", F.col("to").alias("end"))).alias("far"))

    ends = sweep(kinds.withColumn("from", F.element_at("wits", 1)))
    best = stored(sweep(ends.withColumn("from", F.col("far.end"))).select(*by, "key", "held", F.col("far.p.edges").alias("spread"), F.col("far.p.length").alias("branch")), "spreads")
    # Sets that hold more than one row in HOT_SHARE (so at most that many) meet their rows where these lie; no task gets all rows of one.
    total = sets.agg(F.count("*").alias("total"))
    hot = best.crossJoin(F.broadcast(total)).where(F.col("held") * HOT_SHARE > F.col("total")).drop("held", "total")
    in_hot = sets.join(F.broadcast(hot), [*by, "key"])
    in_rest = sets.join(F.broadcast(hot.select(*by, "key")), [*by, "key"], "left_anti")
    # A set of one witness has no path; neither it nor a null moves to the others.
    alone = in_rest.where("witnesses = 1").withColumn("spread", F.lit(None).cast("int")).withColumn("branch", F.lit(None).cast("double"))
    met = in_hot.unionByName(alone).unionByName(in_rest.where("witnesses > 1").join(best.drop("held"), [*by, "key"], "left"))
    diameter = tree_diameter(paths) if by else paths.agg(F.max("edges").alias("diameter"))
    out = met.join(diameter, by) if by else met.crossJoin(F.broadcast(diameter))  # one row
    single = F.col("witnesses") == 1
    return out.select(*by, *COLUMN, "reading", "witnesses", F.when(single, 0).otherwise(F.col("spread")).alias("spread"), F.round(F.when(single, 0.0).otherwise(F.col("branch")), 6).alias("branch"), F.round(F.when(single, 1.0).otherwise(F.col("spread")) / F.col("diameter"), 6).alias("ratio"))
