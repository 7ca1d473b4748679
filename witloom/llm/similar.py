"""Near copies by word shingles: joins the groups that SimHash leaves apart though their texts share most shingles.

Texts of different groups that agree in one band of minimum hashes are candidates; the similarity of their shingle sets
(Jaccard) is then computed exactly, so only pairs at or above the threshold link. At a similarity of 0.8 a pair misses all
bands with a probability of 0.0002.

Pairs of a band's bucket are never listed as such: a bucket's members meet a few leaders, groups grow by the links found,
leaders leave, and buckets whose members all lie in one group are done. This goes on until no bucket is left, with more
leaders every round, so no link between different groups is lost, however many texts a bucket holds.

Near copies that don't link would still meet each other all, so three exact means spare them that. Leaders come from outside
their bucket's largest group, whose members need not meet each other, and are those that share most buckets with others.
A pair goes on only if the parities of its shingles' hashes over BITS places leave room for a link: as many shingles differ
as places at least. A text of a large bucket leaves it if too many of its shingles stand in no other text of such buckets.

Defined results: a text of fewer words than a shingle is one shingle; a text without words takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, slices, spread_join, stored
from .components import components

BANDS, ROWS = 16, 4
#: Leaders of a bucket in the first rounds; the last number holds for every later one.
LEADERS = (1, 16, 256, 1024)
#: Places of the parities kept of a text's shingles.
BITS = 512
#: Members of a bucket above which their shingles are counted, once, after the first turn; smaller ones are soon done without.
LARGE = 256
CHUNK = 2048

_MIX = np.random.default_rng(5).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands of a set of shingle hashes, as signed longs."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[k : k + CHUNK, None] * _MIX[0] + _MIX[1]).min(axis=0))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def parities(hashes: np.ndarray) -> tuple[int, list[int]]:
    """The number of different hashes, and whether an odd number of them falls on each of BITS places, as signed longs."""
    found = np.unique(hashes)
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
    return len(found), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sets(hashes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = [np.unique(np.array(hashes(t, size), np.uint64)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["fp", "t", "shingles"])

    return run


def _open(members: DataFrame) -> DataFrame:
    """Members (bucket, fp, t, group, size, ...) of the buckets that still hold more than one group; with the bucket's number of
    members (held) and least size (smallest)."""
    members = members.drop("held", "smallest")
    ends = members.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("size").alias("smallest"), F.count("*").alias("n")).where("low < high")
    return stored(spread_join(members, stored(ends.select("bucket", "smallest", F.col("n").alias("held"), "n"), "buckets"), ["bucket"], ["t"], sized=True), "members")


def _shingle_sets(members: DataFrame, texts: DataFrame, docs: DataFrame, hashes, size: int) -> DataFrame:
    """fp, t, shingles of the members' texts, read from the whole texts once."""
    needed = stored(members.select("fp", "t").distinct().join(texts.select("fp", "t", "row.k_", "row.b_"), ["fp", "t"]), "needed")
    found = needed.join(docs.select("k_", "b_", F.col("text").cast("string").cast("binary").alias("text")), ["k_", "b_"])
    found = found.groupBy("fp", "t").agg(F.any_value("text").alias("text"))
    return stored(found.mapInArrow(_sets(hashes, size), "fp long, t long, shingles array<long>"), "shingles")


def _bounded(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Members without those of large buckets that can't link in them.

    A text of n shingles of which at most c stand in other texts of large buckets needs c >= least / (1 + least) * (n + m) to
    link with a text of m shingles, and m is neither below least * n nor below the smallest size in the bucket.
    """
    large = members.where(F.col("held") > LARGE).select("fp", "t", "size").distinct()
    shingles = large.join(sets, ["fp", "t"]).select("fp", "t", F.explode("shingles").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.min("fp").alias("fp"), F.min("t").alias("t"), F.count("*").alias("n")).where("n = 1")
    alone = alone.groupBy("fp", "t").agg(F.count("*").alias("alone"))
    reach = (F.col("size") - F.col("alone")) * ((1 + least) / least) - F.col("size") + 1e-6
    reach = stored(large.join(alone, ["fp", "t"]).select("fp", "t", reach.alias("reach")), "reach")
    known = members.join(reach, ["fp", "t"], "left")
    return known.where(F.col("reach").isNull() | (F.col("held") <= LARGE) | (F.col("reach") >= F.greatest(least * F.col("size"), F.col("smallest")))).drop("reach")


def _leads(members: DataFrame, turn: int) -> DataFrame:
    """bucket, leads (at most as many as the turn allows), n: the bucket's members. From the second turn on none is of the bucket's largest group."""
    part = F.pmod(F.xxhash64("fp", "t", F.lit(turn)), F.lit(LEADERS[min(turn, len(LEADERS) - 1)]))
    able = members
    if turn:
        counts = members.groupBy("bucket", "group").agg(F.count("*").alias("of"))
        most = counts.groupBy("bucket").agg(F.max_by("group", F.struct("of", "group")).alias("most"), F.sum("of").alias("n"))
        able = spread_join(members, stored(most, "most"), ["bucket"], ["t"], sized=True).where("group <> most")
    lead = F.min_by(F.struct("fp", "t", "group", "size", "odd"), F.struct(-F.col("central"), F.col("fp"), F.col("t")))
    led = able.groupBy("bucket", part.alias("part")).agg(lead.alias("lead"), F.any_value("held").alias("n"))
    return stored(led.groupBy("bucket").agg(F.collect_list("lead").alias("leads"), F.any_value("n").alias("n")), "leaders")


def _may_link(lead: Column, least: float) -> Column:
    """Whether a member and a leader are of different groups and may be alike by ``least``: at most so many shingles differ then."""
    most = (F.col("size") + lead["size"]) * ((1 - least) / (1 + least)) + 1e-6
    apart = [F.bit_count(F.col("odd")[k].bitwiseXOR(lead["odd"][k])) for k in range(BITS // 64)]
    return (F.col("group") != lead["group"]) & (F.abs(F.col("size") - lead["size"]) <= most) & (reduce(add, apart) <= most)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: the groups of the pairs (a, a_fp, a_t, b, b_fp, b_t) with a similarity of ``least`` or more."""
    both = pairs
    for s, other in ("ab", "ba"):
        counted = pairs.groupBy(f"{s}_fp", f"{s}_t").agg(F.count("*").alias("n"))
        counted = counted.join(sets.select(F.col("fp").alias(f"{s}_fp"), F.col("t").alias(f"{s}_t"), F.col("shingles").alias(f"{s}_set")), [f"{s}_fp", f"{s}_t"])
        both = spread_join(both, counted, [f"{s}_fp", f"{s}_t"], [f"{other}_t"], sized=True)
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(shared / (F.size("a_set") + F.size("b_set") - shared) >= least).select("a", "b").distinct()


def joined_groups(texts: DataFrame, groups: DataFrame, docs: DataFrame, hashes, size: int = 5, least: float = 0.8) -> DataFrame:
    """fp, group: ``groups`` (fp, group) after joining all groups that hold texts of a similarity of ``least`` or more.

    ``texts``: fp, t, row (with k_ and b_), bands, size and odd (see ``parities``), one row a different text; ``docs``: k_, b_, text; ``hashes``: the
    function of a text and a shingle size that returns its shingles' hashes.
    """
    members = _open(texts.join(groups, "fp").select(F.explode("bands").alias("bucket"), "fp", "t", "group", "size"))
    if not members.limit(1).count():
        return groups
    sets = _shingle_sets(members, texts, docs, hashes, size)
    known = members.groupBy("fp", "t").agg(F.sum("held").alias("central")).join(texts.select("fp", "t", "odd"), ["fp", "t"])
    was, members = members, stored(members.join(known, ["fp", "t"]), "members")
    drop(was)
    turn = 0
    while members.limit(1).count():
        led = _leads(members, turn)
        near = F.filter("leads", lambda lead: _may_link(lead, least))
        met = spread_join(members, led, ["bucket"], ["t"], sized=True).select("fp", "t", "group", F.explode(near).alias("lead"))
        one, two = F.struct("group", "fp", "t"), F.struct("lead.group", "lead.fp", "lead.t")
        met = met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
        pairs = stored(met.select(F.col("a.group").alias("a"), F.col("a.fp").alias("a_fp"), F.col("a.t").alias("a_t"), F.col("b.group").alias("b"), F.col("b.fp").alias("b_fp"), F.col("b.t").alias("b_t")), "pairs")
        edges = stored(_verified(pairs, sets, least), "similar")
        rest = members.join(led.select("bucket", F.explode("leads").alias("lead")).select("bucket", "lead.fp", "lead.t"), ["bucket", "fp", "t"], "left_anti")
        if edges.limit(1).count():
            nodes = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("weight"))
            merged = components(edges, nodes).select(F.col("node").alias("group"), "component")
            renamed = lambda rows: rows.join(merged, "group", "left").withColumn("group", F.coalesce("component", "group")).drop("component")  # noqa: B023, E731
            groups, rest = stored(renamed(groups), "groups"), renamed(rest)
        was, members = members, _open(rest)
        if not turn and members.where(F.col("held") > LARGE).limit(1).count():
            all_, members = members, _open(_bounded(members, sets, least))
            drop(all_)
        for frame in (was, led, pairs, edges):
            drop(frame)
        turn += 1
    drop(sets)
    return groups
