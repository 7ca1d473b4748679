"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``RULES`` is data: each row names a measure, an integer share and its limits. Shares are compared in whole numbers
(``100 * part`` against ``percent * whole``), so any engine gives the same verdicts.

Defined results: null text has no words and fails; ids may be null or repeated (one row out for each row in); other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with this at from by be or an "
    "der die das und ist ein eine nicht mit für auf den dem des im sich auch zu von "
    "le la les et est une un des du de que qui dans pour pas sur par au avec ne "
    "el los las y es una en por con para del al se no lo su como más"
).split()


class Rule(NamedTuple):
    """A document passes if ``at_least`` <= 100 * part / whole <= ``at_most`` (either may be None)."""

    name: str
    part: str
    whole: str
    at_least: int | None
    at_most: int | None


#: The threshold table. Measures: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_stop, one (always 1).
RULES = (
    Rule("length", "n_words", "one", 100 * 20, 100 * 200_000),
    Rule("mean word length", "word_chars", "n_words", 100 * 2, 100 * 14),
    Rule("symbols", "n_symbols", "n_words", None, 25),
    Rule("stop words", "n_stop", "n_words", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 30),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array, first occurrence included."""
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered() -> Column:
        keyed = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice(words, i, window)).alias("h"), F.hash(F.slice(words, i, window)).alias("g"), i.alias("i")))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (a["g"] == b["g"])

        def found(s: Column) -> Column:
            # Position in the sorted array counts from 0: its neighbours are elements k and k + 2 counted from 1.
            return F.filter(s, lambda x, k: ((k > 0) & same(F.try_element_at(s, F.greatest(k, F.lit(1))), x)) | F.coalesce(same(F.try_element_at(s, k + 2), x), F.lit(False)))

        at = _let(F.sort_array(keyed), lambda s: F.sort_array(F.transform(found(s), lambda x: x["i"])))
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(window), p - a["last"])).alias("total")), lambda a: a["total"])

    return F.when(F.size(words) < window, 0).when(F.size(F.array_distinct(hashes)) == F.size(words) - (window - 1), 0).otherwise(covered())


def passes(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * 100, F.col(rule.whole)
    tests = [part >= rule.at_least * whole] if rule.at_least is not None else []
    tests += [part <= rule.at_most * whole] if rule.at_most is not None else []
    return reduce(Column.__and__, tests)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    measured = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines")).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.lit(1).cast("long").alias("one"),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdicts = [F.when(~passes(r), F.lit(r.name)) for r in rules]
    failed = F.concat_ws(",", *verdicts)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select(*out, base.alias("base_failed"), (~base & (failed == "")).alias("kept"), failed.alias("failed_rules"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table in DuckDB's SQL."""
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    tests = {r.name: " AND ".join([f"{r.part} * 100 >= {r.at_least} * {r.whole}"] * (r.at_least is not None) + [f"{r.part} * 100 <= {r.at_most} * {r.whole}"] * (r.at_most is not None)) for r in rules}
    failed = ", ".join(f"CASE WHEN NOT ({t}) THEN '{n}' END" for n, t in tests.items())
    return f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS s FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM dup) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop, 1 AS one FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM v"""
