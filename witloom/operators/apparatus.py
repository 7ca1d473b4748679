"""Collation with a base witness, and the apparatus made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import COLUMN


def base_witness(cells: DataFrame) -> DataFrame:
    """The first witness of each passage."""
    return cells.groupBy("passage_id").agg(F.min_by("siglum", "wit_ord").alias("base"))


def base_collation(cells: DataFrame, base: DataFrame, normalised: bool = False) -> DataFrame:
    """Every other witness's reading beside the base's, column by column; a gap reads ``[om.]``.

    ``normalised``: the base shows its lemma where it has one, and agrees with a reading or a lemma equal to that.
    The base is 1/k of the cells, joined on the column key, so neither side meets a hot key.
    """
    shown = F.coalesce("lemma", "reading") if normalised else F.col("reading")
    marked = cells.join(base, "passage_id").withColumn("shown", shown)
    own = marked.where(F.col("siglum") == F.col("base")).select(*COLUMN, F.col("reading").alias("base_reading"), F.col("shown").alias("base_shown"))
    rest = marked.where(F.col("siglum") != F.col("base")).join(own, COLUMN)
    agrees = (F.col("shown") == F.col("base_shown")) | (F.col("reading") == F.col("base_shown"))
    return rest.select(*COLUMN, "base", "base_reading", "siglum", "wit_ord", F.when(F.col("reading") == "", "[om.]").otherwise(F.col("reading")).alias("variant"), agrees.alias("agrees"))


def entries(collated: DataFrame) -> DataFrame:
    """One entry for each column with a disagreeing reading: passage_id, n, base_reading, positive (sigla in witness order),
    negative (variant, sigla; by first witness)."""
    sigla = F.transform(F.sort_array(F.collect_list(F.struct("wit_ord", "siglum"))), lambda x: x["siglum"])
    per = collated.groupBy(*COLUMN, "base_reading", "agrees", F.when(~F.col("agrees"), F.col("variant")).alias("variant")).agg(sigla.alias("sigla"), F.min("wit_ord").alias("first"))
    negative = F.sort_array(F.collect_list(F.when(~F.col("agrees"), F.struct("first", "variant", "sigla"))))
    both = per.groupBy(*COLUMN, "base_reading").agg(F.max(F.when(F.col("agrees"), F.col("sigla"))).alias("positive"), negative.alias("negative"))
    return both.where("size(negative) > 0").withColumn("positive", F.coalesce("positive", F.array().cast("array<string>")))


def apparatus(collated: DataFrame) -> DataFrame:
    """The entries as text: lemma, its witnesses, then the readings by first witness.

    The trailing space of a lemma stands outside it (``spaced``).
    """
    negative = F.transform("negative", lambda x: F.concat_ws(" ", x["variant"], F.array_join(x["sigla"], " ")))
    lemma = F.when(F.col("base_reading") == "", "[om.]").otherwise(F.rtrim("base_reading"))
    return entries(collated).select(*COLUMN, lemma.alias("lemma"), F.endswith("base_reading", F.lit(" ")).alias("spaced"), F.array_join("positive", " ").alias("positive"), F.array_join(negative, "; ").alias("negative"))
