"""Transliteration by remembered pieces of texts, against a plain programme that goes letter by letter."""

import random
import re

from pyspark.sql import functions as F

from witloom.functions import translit
from witloom.plans import derived, queries

from .test_moves import documents, plan

BLOCK = {script: {n: translit._block(script, getattr(translit, f"INDIC_{n}")) for n in ("VOWELS", "MARKS", "CONSONANTS", "OTHER")} for script in ("devanagari", "telugu")}


def spelt(text, script):
    """Letter by letter, after the joins as they are written."""
    text = text.replace("ṙ", "r‍" if script == "telugu" else "r").lower()
    for pattern, by in translit.JOINS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", by), text)
    b, virama = BLOCK[script], chr(translit.BLOCKS[script] + translit.VIRAMA)
    letters = b["VOWELS"] | b["CONSONANTS"] | b["OTHER"] | translit.DANDAS
    out, behind = "", False
    while text:
        t = next((text[:k] for k in (4, 3, 2) if text[:k] in letters), text[:1])
        mark = "" if t == "a" else b["MARKS"].get(t)
        out += (virama if mark is None else "") * behind + (mark if behind and mark is not None else letters.get(t, t))
        behind, text = t in b["CONSONANTS"], text[len(t) :]
    return out + virama * behind


def roman(text, script):
    b, virama = BLOCK[script], chr(translit.BLOCKS[script] + translit.VIRAMA)
    names = {v: k for n in ("VOWELS", "MARKS", "CONSONANTS", "OTHER") for k, v in b[n].items()} | {virama: ""} | {v: k for k, v in translit.DANDAS.items()}
    signs = [*b["MARKS"].values(), virama]
    return "".join(names.get(t, t) + ("a" if t in b["CONSONANTS"].values() and text[k + 1 : k + 2] not in signs else "") for k, t in enumerate(text)).replace("‍", "")


def test_texts_of_any_letters(spark):
    rnd = random.Random(8)
    # Many single letters between spaces: a join takes the letters of one match, so not every space goes.
    some = [*translit.INDIC_VOWELS, *translit.INDIC_CONSONANTS, *translit.INDIC_OTHER, *"| || _ ü ï 😀 \n".split(" "), *[" "] * 40]
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["k g c t", "", "k", " ṃ ", "ka" * 200, "kkkk" * 40]
    made = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", *[translit.roman_to_indic(F.col("t"), s).alias(s) for s in BLOCK])
    back = made.withColumn("back", translit.indic_to_roman(F.col("telugu"), "telugu"))
    assert "regexp_extract_all" not in plan(back)
    rows = back.collect()
    assert [tuple(r) for r in rows if r["t"] is None] == [(None,) * 4]
    for r in rows:
        if r["t"] is not None and not r["t"].startswith(("_ā", "_y")):
            assert (r["devanagari"], r["telugu"]) == (spelt(r["t"], "devanagari"), spelt(r["t"], "telugu")), r["t"]
            assert r["back"] == roman(r["telugu"], "telugu")


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(translit, "REMEMBERED", 50)
    pieces = translit._indic_pieces("telugu")
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("kgtnaiu ") for _ in range(60)) for _ in range(40)] + ["k" * 500 + "a"]
    assert [pieces.text(t) for t in texts] == [translit._spelt("telugu", {})(t) for t in texts]
    assert 0 < len(pieces) <= 50 and max(map(len, pieces)) <= translit.LONGEST


def test_parts_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Large files are dealt to more parts, so a task's texts are bounded."""
    d = documents(spark, tmp_path)
    few = derived.words_text(spark, d).rdd.getNumPartitions()
    monkeypatch.setattr(derived, "PART_BYTES", 10)
    assert derived.words_text(spark, d).rdd.getNumPartitions() > few
    assert queries.translit_indic_to_roman(spark, d).count() == 40
