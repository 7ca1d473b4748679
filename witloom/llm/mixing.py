"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's documents lie end to end, shard by shard, in an order drawn by a seeded hash, and are cut into blocks
of equal tokens. The targets are turned into whole numbers of words by highest quotients ``target / (2 k + 1)``:
first over the sources, then over the shards of each source. A shard that may take ``q`` words and holds ``n`` takes
every word ``q // n`` times and ``q % n`` words once more: whole blocks drawn by a seeded hash, and the first words of
the next block drawn. With ``whole``, these are the shard's first documents in its seeded order, the last of them cut.

A source is split into hash shards by its size, so one that holds most rows is no single task and a small one is not
crumbled; per-document work runs inside a shard, per-source work on one row a source.

Defined results: a null text has size 0 and takes 0; a null source is a source, ordered last; equal rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

WEIGHTS = (5, 2, 1)
#: Most times that a source, and so a document, is taken.
REPEATS = 3
#: Blocks into which the whole mix is cut; those of a shard with fewer than SHARD_BLOCKS of them are smaller.
BLOCKS = 2_000_000
#: Blocks that a shard holds at least, and shards that a source is split into at most.
SHARD_BLOCKS = 64
SHARDS = 1024
#: Words that a shard holds at least where whole documents are taken: each shard cuts one.
SHARD_WORDS = 1_000_000
SEED = 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: shares by weight of the whole, none above ``repeats`` times its size.

    ``sizes`` holds one row for each source. The capped sources are those of the least size per weight: in that order,
    source i is capped if its cap lies below its share of what the capped ones before it leave.
    """
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1, F.lit(n)) + 1).cast("int")).cast("double")
    cap = F.col("source_size").cast("double") * repeats
    w = sizes.withColumn("weight", weight).withColumn("cap", cap)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.sum("weight").over(after))
    w = w.withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return w.withColumn("final", level).select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, by: list[str], names: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` of every group ``by`` dealt to its rows by the highest quotients votes / (2 k + 1).

    Whole seats below each row's fair share less one are certain; only the few quotients about it are ranked.
    ``seats`` must not differ within a group.
    """
    total = F.sum(votes).over(Window.partitionBy(*by))
    p = parties.withColumn("seats_", seats).withColumn("fair", F.when(total > 0, F.col(votes) / total * F.col("seats_")).otherwise(F.lit(0.0)))
    p = p.withColumn("sure", F.greatest(F.floor("fair") - 2, F.lit(0)).cast("long"))
    ks = p.withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("sure") + 5))).withColumn("quotient", F.col(votes) / (2 * F.col("k") + 1))
    rank = Window.partitionBy(*by).orderBy(F.col("quotient").desc(), *[F.col(x).asc_nulls_last() for x in names], "k")
    ks = ks.withColumn("rank", F.row_number().over(rank)).withColumn("free", F.col("seats_") - F.sum(F.when(F.col("k") == F.col("sure"), F.col("sure")).otherwise(0)).over(Window.partitionBy(*by)))
    won = F.sum((F.col("rank") <= F.col("free")).cast("long"))
    kept = [c for c in parties.columns if c not in names]
    return ks.groupBy(*[F.col(x) for x in dict.fromkeys([*by, *names])]).agg(*[F.first(c).alias(c) for c in kept if c not in by], (F.first("sure") + won).alias("quota"))


def lot(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("source_key"), F.col("shard"), block)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, full_copies, and the columns ``keep``; one row for each document.

    ``taken`` counts the words of the blocks taken that lie in the document, repeats counted. ``whole``: what is taken beyond
    full copies of a shard is whole documents and the first words of one more.
    """
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    if keep and "text" in keep:
        raise ValueError("join the texts afterwards: they would pass through two shuffles here")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    kept = [F.struct(*keep).alias("kept_")] if keep else []
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), *kept, key.alias("source_key"))
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sized = stored(sized.withColumn("draw", mixed), "sizes")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    key_of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    everything = Window.partitionBy()
    block = F.greatest(F.floor(F.sum("source_size").over(everything) / blocks), F.lit(1)).cast("long")
    asked = sources.withColumn("source_key", key_of).withColumn("block", block).withColumn("all", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(everything)).cast("long"))
    split = F.least(F.greatest(F.floor(F.col("source_size") / (F.lit(SHARD_WORDS) if whole else F.col("block") * SHARD_BLOCKS)), F.lit(1)), F.lit(shards))
    asked = stored(asked.withColumn("n_shards", split.cast("long")), "asked")
    sharded = sized.join(asked.select("source_key", "n_shards"), "source_key").withColumn("shard", F.pmod("draw", "n_shards").cast("int"))
    cells = stored(sharded.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    per_source = sainte_lague(asked, "target", F.col("seats"), ["all"], ["source_key"]).select("source_key", "source_size", "target", "block", "quota")
    parts = cells.select("source_key", "shard", "shard_size").join(per_source, "source_key")
    # Quotas of a source's shards follow the shards' sizes.
    shares = sainte_lague(parts.withColumnRenamed("quota", "of_source"), "shard_size", F.col("of_source"), ["source_key"], ["shard"])
    # Small shards have smaller blocks; the last block may be short.
    shares = shares.withColumn("block", F.greatest(F.least("block", F.floor(F.col("shard_size") / SHARD_BLOCKS)), F.lit(1)).cast("long"))
    count = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    times = F.when(F.col("shard_size") > 0, F.least(F.floor(F.col("quota") / F.col("shard_size")), F.lit(REPEATS))).otherwise(F.lit(0)).cast("long")
    shares = shares.withColumn("n_blocks", count).withColumn("times", times)
    rest = F.when((F.col("shard_size") > 0) & (F.col("times") < REPEATS), F.col("quota") - F.col("times") * F.col("shard_size")).otherwise(0)
    shares = stored(shares.withColumn("rest", rest.cast("long")), "quotas")
    if whole:
        plan = shares.select("source_key", "shard", "source_size", "target", "times", "rest")
    else:
        drawn = shares.where("rest > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumn("lot", lot(F.col("b"), seed))
        drawn = drawn.withColumn("words", F.least("block", F.col("shard_size") - F.col("b") * F.col("block")))
        ranked = Window.partitionBy("source_key", "shard").orderBy("lot", "b").rowsBetween(Window.unboundedPreceding, -1)
        # The drawn blocks are those whose lot does not exceed the last one that fits; the one behind it gives what is left.
        drawn = drawn.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(ranked), F.lit(0))).where("left > 0")
        full = F.col("words") <= F.col("left")
        drawn = drawn.groupBy("source_key", "shard").agg(F.max(F.when(full, F.col("lot"))).alias("cut"), F.max(F.when(~full, F.struct("b", "left"))).alias("split"))
        plan = shares.join(drawn, ["source_key", "shard"], "left").select("source_key", "shard", "source_size", "target", "block", "n_blocks", "times", "cut", "split")
    place = Window.partitionBy("source_key", "shard").orderBy("draw", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sharded.withColumn("at", F.coalesce(F.sum("size").over(place), F.lit(0))).join(plan, ["source_key", "shard"])
    if whole:
        more = F.greatest(F.least("size", F.col("rest") - F.col("at")), F.lit(0))
    else:
        first_b, last_b = F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block"))

        def overlap(b: Column, words: Column) -> Column:
            low, high = F.greatest(F.col("at"), b * F.col("block")), F.least(F.col("at") + F.col("size"), b * F.col("block") + words)
            return F.greatest(high - low, F.lit(0)).cast("long")

        touched = F.when(F.col("cut").isNull(), F.array().cast("array<bigint>")).otherwise(F.filter(F.sequence(first_b, last_b), lambda b: lot(b, seed) <= F.col("cut")))
        more = F.aggregate(touched, F.lit(0).cast("long"), lambda a, b: a + overlap(b, F.col("block")))
        split = F.when(F.col("split").isNotNull(), overlap(F.col("split.b"), F.col("split.left"))).otherwise(0)
        more = F.when(F.col("size") > 0, more + split).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + more).cast("long").alias("taken"), F.col("times").cast("int").alias("full_copies"), *(["kept_.*"] if keep else []))
