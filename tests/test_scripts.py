"""Romanised texts in Grantha and Tamil letters: outputs spelt out by the rules, letter by letter."""

import pytest
from pyspark.sql import functions as F

from witloom.functions.translit import indic_to_roman, roman_to_indic

GRANTHA = {
    "vak": "വക്",  # no final letter of its own
    "bhavas": "ഭവ\ue1d3",
    "tac ca": "തച്ച",  # runs on, so no final
    "vāc, ": "വാ\ue1b6, ",
    "tad": "ത\ue1c2",
    "punar": "പുനർ",
    "dharma": "ധൎമ",  # r before a consonant
    "kṣitiḥ": "க்ஷிതിഃ",  # one sign of Tamil script
    "_ātmā": "ഽ\u200dാത്മാ",
    "oḿ": "ഒം",
}
TAMIL = {
    "tamiḻ": "தமிழ்",
    "avaṉ iru": "அவனிரு",  # joined over the space
    "kō": "கோ",
    "ko": "கொ",
    "ṉaiy": "னைய்",
    "gītā": "𑌗𑍀தா",  # a borrowed consonant takes the sign of its block
    "dharma": "𑌧ர்ம",
    "bodh": "𑌬𑍋𑌧𑍍",
    "kṛṣṇa": "க𑍃ஷ்ண",
    "kaI": "க\u200cஇ",
    "a·i": "அ\u200cஇ",
    "oṁ | ||": "ௐ । ॥",
    "naḥ ḵa": "ந𑌃 ஃஅ",
    "12": "௧௨",
}


@pytest.mark.parametrize(("script", "wanted"), [("grantha", GRANTHA), ("tamil", TAMIL)])
def test_display_scripts(spark, script, wanted):
    texts = spark.createDataFrame([(t,) for t in [*wanted, "", None]], "t string")
    got = {r["t"]: r["made"] for r in texts.select("t", roman_to_indic(F.col("t"), script).alias("made")).collect()}
    assert got == wanted | {"": "", None: None}


def test_other_scripts(spark):
    row = spark.createDataFrame([("_āgata ¯",)], "t string").select(*[roman_to_indic(F.col("t"), s).alias(s) for s in ("devanagari", "telugu")]).first()
    assert row["devanagari"] == "ऽ\u200dागत ꣻ" and row["telugu"] == "ఽ\u200dాగత ¯"
    assert spark.createDataFrame([("தமிழ்",)], "t string").select(indic_to_roman(F.col("t"), "tamil")).first()[0] == "tamiḻ"
