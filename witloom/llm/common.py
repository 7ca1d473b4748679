"""What the training-data operators share: reading tables, texts and their words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, shared_dir, stored  # noqa: F401

#: ASCII white space as the contracts define it: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text (one long text may exceed it);
    with each run, its texts as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        start, held = 0, 0
        lengths = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start), [x or b"" for x in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start), [x or b"" for x in texts.slice(start).to_pylist()]


#: At most so many keys can each hold more than one in so many rows.
HOT_KEYS = 10_000
#: Parts that the rows of such a key are dealt to.
SALTS = 64


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str], sized: bool = False) -> DataFrame:
    """Inner join with ``few`` (one row a key, with ``n``, the rows of ``many`` that have it); ``n`` goes.

    Rows of keys that hold more than one in HOT_KEYS of all rows are dealt over SALTS parts by a hash of ``by``: there are
    at most HOT_KEYS such keys, a bounded broadcast, and only their rows of ``few`` are copied.
    ``sized``: to as many parts as their rows ask for, so that all copies together are 2 * HOT_KEYS rows at most.
    """
    total = few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.least(F.lit(SALTS), F.ceil(F.col("n") * HOT_KEYS / max(1, total))).cast("int") if sized else F.lit(SALTS)
    hot = few.where(F.col("n") * HOT_KEYS > total).select(*on, parts.alias("hot_"))
    return _dealt(many, few.drop("n"), on, by, hot, "inner")


def spread_left_join(many: DataFrame, few: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Left join with ``few`` (one row a key). Frequent keys are dealt out whether ``few`` has them or not.

    Keys are counted first, from ``many``; those with more than one in HOT_KEYS of its rows go to as many parts as their rows ask for.
    """
    total = many.count()
    held = many.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") * HOT_KEYS > total)
    parts = F.least(F.lit(SALTS), F.ceil(F.col("n") * HOT_KEYS / max(1, total))).cast("int")
    return _dealt(many, few, on, by, stored(held.select(*on, parts.alias("hot_")), "hot-keys"), "left")


def _dealt(many: DataFrame, few: DataFrame, on: list[str], by: list[str], hot: DataFrame, how: str) -> DataFrame:
    hot = F.broadcast(hot)
    salt = F.when(F.col("hot_").isNotNull(), F.pmod(F.xxhash64(*by), F.col("hot_"))).otherwise(0).cast("int")
    salts = F.when(F.col("hot_").isNotNull(), F.sequence(F.lit(0), F.col("hot_") - 1)).otherwise(F.array(F.lit(0)))
    left = many.join(hot, on, "left").withColumn("salt_", salt).drop("hot_")
    right = few.join(hot, on, "left").withColumn("salt_", F.explode(salts)).drop("hot_")
    return left.join(right, [*on, "salt_"], how).drop("salt_")
