"""Text functions over a stream of witnesses: they keep no state, so each row is done as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import normalise_text
from ..functions.translit import detect_script, iast_to_slp1


def normalised_witnesses(witnesses: DataFrame) -> DataFrame:
    """passage_id, siglum, script, norm; works on a batch and on a streaming frame alike."""
    return witnesses.select("passage_id", "siglum", detect_script(F.col("seq")).alias("script"), normalise_text(iast_to_slp1(F.col("seq"))).alias("norm"))
