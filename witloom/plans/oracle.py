"""The queries' results as DuckDB SQL over the given tables."""

from __future__ import annotations

from ..functions.normalise import COLLAPSE_SPACES, RULES
from ..functions.translit import HK_FROM, HK_TO, IAST, IAST_TO_SLP1, SLP1, all_glyphs, alternatives

#: The letters and symbols that the queries use, stated again. Rule and letter tables of normalisation and transliteration are those of the code.
FROM, TO = "éèêüöäñçóáíßÉÈÊÜÖÄÑÇÓÁÍxqj", "āīūṛṝāñśṝāīṣāīūṛṝāñśṝāīṣṭñ"
ROMAN = f"lower(regexp_replace(translate(text, '{FROM}', '{TO}'), '[^a-zA-Zñāīśūṛṝṣṭ]+', ' ', 'g'))"
STATES = "123456789ABCDEFGHKLMNPQRSTUVWXYZabcdefghklmnpqrstuvwxyz"

VIEWS = {
    "seqs": f"""SELECT CAST(floor(doc_id / 8) AS BIGINT) AS passage_id, CAST(doc_id % 8 AS INTEGER) AS wit_ord, 'W' || CAST(doc_id % 8 AS VARCHAR) AS siglum,
        {ROMAN} AS seq FROM documents""",
    "copies": f"""SELECT doc_id AS passage_id, unnest([0, 1, 2]) AS wit_ord, array_to_string(unnest([w, list_filter(list_transform(w, lambda x, i: CASE WHEN (doc_id + 7 * (i - 1)) % 23 = 0 THEN '' WHEN (doc_id + i - 1) % 31 = 0 THEN x || 'a' ELSE x END), lambda x: x <> ''),
        list_concat(list_concat(o[1:20], CASE WHEN doc_id % 4 = 0 THEN [reverse(substr(seq, 1, 300))] ELSE [] END), o[21:])]), ' ') AS seq
        FROM (SELECT *, list_transform(w, lambda x, i: CASE WHEN (3 * doc_id + i - 1) % 19 = 0 THEN translate(x, 'aeo', 'eoa') WHEN (doc_id + 5 * (i - 1)) % 41 = 0 THEN x || ' et' ELSE x END) AS o
              FROM (SELECT doc_id, seq, list_filter(string_split(seq, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {ROMAN} AS seq FROM documents)))""",
    "letters": "SELECT passage_id, wit_ord, x, count(*) AS times FROM (SELECT passage_id, wit_ord, unnest(string_split(replace(seq, ' ', ''), '')) AS x FROM copies WHERE wit_ord < 2) WHERE x <> '' GROUP BY 1, 2, 3",
    "texts": f"SELECT doc_id, {ROMAN} AS seq FROM documents",
    "raw_cells": """SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS passage_id, CAST(l_orderkey % 16 AS INTEGER) AS wit_ord, CAST(l_linenumber - 1 AS INTEGER) AS n,
        min(l_returnflag || l_linestatus) AS reading FROM lineitem GROUP BY 1, 2, 3""",
    "cells": """SELECT w.passage_id, w.wit_ord, 'W' || CAST(w.wit_ord AS VARCHAR) AS siglum, c.n, coalesce(r.reading, '') AS reading
        FROM (SELECT DISTINCT passage_id, wit_ord FROM raw_cells) w CROSS JOIN (SELECT DISTINCT n FROM raw_cells) c
        LEFT JOIN raw_cells r ON r.passage_id = w.passage_id AND r.wit_ord = w.wit_ord AND r.n = c.n""",
    "cols": "SELECT DISTINCT passage_id, n, CAST(floor(n / 3) AS INTEGER) AS group_id, n % 7 = 5 AS insignificant, n % 7 = 2 AS \"binary\" FROM cells",
    "norm": "SELECT *, CASE WHEN n % 2 = 0 AND reading <> '' THEN substr(reading, 1, 1) END AS lemma FROM cells",
    "spaced": "SELECT passage_id, wit_ord, siglum, n, CASE WHEN reading <> '' AND (wit_ord + n) % 3 <> 0 THEN reading || ' ' ELSE reading END AS reading FROM cells",
    "holed": "SELECT passage_id, wit_ord, siglum, n, CASE WHEN (passage_id + n) % 5 = 0 OR (passage_id + wit_ord) % 11 = 0 THEN '' ELSE reading END AS reading FROM cells",
    "marked": "SELECT passage_id, wit_ord, siglum, n, CASE WHEN reading = '' THEN '[]' ELSE reading END AS reading FROM cells",
    "picked": "SELECT passage_id, n FROM cols WHERE (passage_id + n) % 4 = 0",
    "base": "SELECT passage_id, arg_min(siglum, wit_ord) AS base FROM cells GROUP BY 1",
    "coll": """SELECT c.passage_id, c.n, base, o.reading AS base_reading, c.siglum, c.wit_ord, CASE WHEN c.reading = '' THEN '[om.]' ELSE c.reading END AS variant, c.reading = o.reading AS agrees
        FROM spaced c JOIN base USING (passage_id) JOIN spaced o ON o.passage_id = c.passage_id AND o.n = c.n AND o.siglum = base WHERE c.siglum <> base""",
    "app": """SELECT passage_id, n, CASE WHEN base_reading = '' THEN '[om.]' ELSE rtrim(base_reading, ' ') END AS lemma, suffix(base_reading, ' ') AS spaced,
          coalesce(max(sigla) FILTER (WHERE agrees), '') AS positive, string_agg(v || ' ' || sigla, '; ' ORDER BY first) FILTER (WHERE NOT agrees) AS negative
        FROM (SELECT passage_id, n, base_reading, agrees, CASE WHEN NOT agrees THEN variant END AS v, string_agg(siglum, ' ' ORDER BY wit_ord) AS sigla, min(wit_ord) AS first FROM coll GROUP BY 1, 2, 3, 4, 5)
        GROUP BY passage_id, n, base_reading HAVING count(*) FILTER (WHERE NOT agrees) > 0""",
    "rdgs": """SELECT passage_id, n, coalesce(max(wits) FILTER (WHERE agrees), '') AS pos, string_agg('<rdg wit="' || wits || '">' || v || '</rdg>', '' ORDER BY first) FILTER (WHERE NOT agrees) AS rdgs
        FROM (SELECT passage_id, n, agrees, CASE WHEN NOT agrees THEN variant END AS v, string_agg('#' || siglum, ' ' ORDER BY wit_ord) AS wits, min(wit_ord) AS first FROM coll GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    "coded": "SELECT passage_id, wit_ord, siglum, n, lower(trim(reading)) AS reading FROM marked",
    "numbered": "SELECT passage_id, n, reading, row_number() OVER (PARTITION BY passage_id, n ORDER BY min(wit_ord), reading) AS state FROM coded WHERE reading NOT IN ('', '[]') GROUP BY 1, 2, 3",
    "states": f"""SELECT m.passage_id, m.siglum, m.wit_ord, m.n, CASE WHEN m.reading = '' THEN '-' WHEN m.reading = '[]' THEN '0' WHEN state > 55 THEN '?' ELSE substr('{STATES}', CAST(state AS INTEGER), 1) END AS symbol
        FROM coded m LEFT JOIN numbered s ON s.passage_id = m.passage_id AND s.n = m.n AND s.reading = m.reading""",
    "labels": """SELECT passage_id, n, concat_ws(' ', chr(39) || '[]' || chr(39), string_agg(chr(39) || reading || chr(39), ' ' ORDER BY state)) AS labels FROM (SELECT DISTINCT passage_id, n FROM cells) LEFT JOIN numbered USING (passage_id, n) GROUP BY 1, 2""",
    "long_states": "SELECT CAST(floor(passage_id / 10) AS BIGINT) AS passage_id, siglum, wit_ord, CAST((passage_id % 10) * 7 + n AS INTEGER) AS n, symbol FROM states",
    "islands": "SELECT *, row_number() OVER (PARTITION BY passage_id, siglum ORDER BY n) - row_number() OVER (PARTITION BY passage_id, siglum, symbol ORDER BY n) AS island FROM long_states",
    "rows_": """SELECT passage_id, siglum, wit_ord, string_agg(s, '' ORDER BY n) AS states FROM (SELECT *, CASE WHEN symbol = '0' AND count(*) OVER (PARTITION BY passage_id, siglum, symbol, island) >= 8 THEN '-' ELSE symbol END AS s FROM islands) GROUP BY 1, 2, 3""",
    "work": "SELECT CAST(floor(passage_id / 10) AS BIGINT) AS work_id, CAST(passage_id % 10 AS INTEGER) AS file_ord, siglum, wit_ord, n, reading FROM cells",
    "edges": "SELECT i AS edge_ord, i // 2 AS source, i AS target, 0.01 * ((i * 7) % 13) AS length FROM range(2, 32) t(i)",
    "paths": """SELECT 'W' || CAST(a - 16 AS VARCHAR) AS a, 'W' || CAST(b - 16 AS VARCHAR) AS b, e AS edges, l AS length FROM (
        SELECT u.n AS a, v.n AS b, min(u.e + v.e) AS e, arg_min(u.l + v.l, u.e + v.e) AS l FROM up u JOIN up v ON u.anc = v.anc WHERE u.n >= 16 AND v.n >= 16 AND 'W' || CAST(u.n - 16 AS VARCHAR) < 'W' || CAST(v.n - 16 AS VARCHAR) GROUP BY 1, 2)""",
    "up": """SELECT 31 AS n, 31 AS anc, 0 AS e, 0.0 AS l WHERE false""",
    "segs": """SELECT conv_id AS passage_id, CAST(turn AS INTEGER) AS seg_no, role AS kind, list_filter(['A', 'B', 'C'], lambda x, i: (turn + i - 1) % 3 <> 0) AS wits, text FROM conversations""",
}
# Ancestors with path lengths: a heap tree has five levels.
VIEWS["up"] = """SELECT i AS n, i // (1 << k) AS anc, k AS e, CAST(coalesce(list_sum(list_transform(range(k), lambda j: 0.01 * (((i // (1 << j)) * 7) % 13))), 0) AS DOUBLE) AS l
        FROM range(1, 32) t(i), range(0, 5) s(k) WHERE i // (1 << k) >= 1"""
NEEDS = {
    "letters": ["copies"],
    "cells": ["raw_cells"], "cols": ["cells"], "norm": ["cells"], "spaced": ["cells"], "holed": ["cells"], "marked": ["cells"], "picked": ["cols"], "base": ["cells"], "coll": ["spaced", "base"], "app": ["coll"], "rdgs": ["coll"],
    "coded": ["marked"], "numbered": ["coded"], "states": ["coded", "numbered"], "labels": ["numbered", "cells"], "long_states": ["states"], "islands": ["long_states"], "rows_": ["islands"], "work": ["cells"], "paths": ["up"],
}

# Fitch on the heap tree, level by level: sets_d and final_d hold the state sets of the nodes 2**d to 2**(d + 1) - 1.
VIEWS["sets_4"] = """SELECT g.passage_id, g.n, CAST(i AS INTEGER) AS node, CASE WHEN c.reading IS NULL THEN CAST([] AS VARCHAR[]) ELSE [c.reading] END AS s
        FROM (SELECT DISTINCT passage_id, n FROM cells) g CROSS JOIN range(16, 32) t(i) LEFT JOIN cells c ON c.passage_id = g.passage_id AND c.n = g.n AND c.wit_ord = i - 16"""
NEEDS["sets_4"] = ["cells"]
for _d in range(3, -1, -1):
    VIEWS[f"sets_{_d}"] = f"""SELECT passage_id, n, parent AS node, CASE WHEN len(shared) > 0 THEN shared ELSE l || list_filter(r, lambda x: NOT list_contains(l, x)) END AS s
        FROM (SELECT *, list_filter(l, lambda x: list_contains(r, x)) AS shared FROM (SELECT passage_id, n, node // 2 AS parent, arg_min(s, node) AS l, arg_max(s, node) AS r FROM sets_{_d + 1} GROUP BY 1, 2, 3))"""
    NEEDS[f"sets_{_d}"] = [f"sets_{_d + 1}"]
VIEWS["final_0"], NEEDS["final_0"] = "SELECT * FROM sets_0", ["sets_0"]
for _d in range(1, 4):
    VIEWS[f"final_{_d}"] = f"""SELECT passage_id, n, node, CASE WHEN len(own) = 1 OR len(shared) = 0 THEN own ELSE shared END AS s
        FROM (SELECT *, list_filter(above, lambda x: list_contains(own, x)) AS shared FROM (SELECT c.passage_id, c.n, c.node, c.s AS own, p.s AS above FROM sets_{_d} c JOIN final_{_d - 1} p ON p.passage_id = c.passage_id AND p.n = c.n AND p.node = c.node // 2))"""
    NEEDS[f"final_{_d}"] = [f"sets_{_d}", f"final_{_d - 1}"]
for _v, _of in (("up_sets", "sets"), ("down_sets", "final")):
    VIEWS[_v] = " UNION ALL ".join(f"SELECT passage_id, n, CAST(node AS VARCHAR) AS node_id, s FROM {_of}_{d}" for d in range(4))
    NEEDS[_v] = [f"{_of}_{d}" for d in range(4)]
LISTED = "CASE WHEN len(s) = 1 AND trim(s[1]) = '' THEN '_' WHEN len(s) = 1 THEN s[1] ELSE '{' || coalesce(list_aggregate(list_transform(s, lambda x: CASE WHEN trim(x) = '' THEN '_' ELSE x END), 'string_agg', ', '), '') || '}' END"
SHOWN = f"CASE WHEN len(s) = 1 THEN trim(s[1]) ELSE {LISTED} END"
SORTED = "coalesce(list_aggregate(list_sort(s), 'string_agg', '|'), '')"
TREES = "(SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 160) AS BIGINT) AS VARCHAR) AS tree_id FROM customer) t"


def sql(body: str, *views: str) -> str:
    """``body`` below the views that it names."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + f"\n{body}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def glyphs(column: str, names: list[str], tail: str = "") -> str:
    return f"regexp_extract_all({column}, {quoted(f'(?s)(?:{alternatives(names)}|.){tail}')})"


def replaced(column: str, pairs: dict[str, str]) -> str:
    return f"list_aggregate(list_transform({glyphs(column, list(pairs))}, lambda t: coalesce(({listed(list(pairs.values()))})[list_position({listed(list(pairs))}, t)], t)), 'string_agg', '')"


PLAIN_RULES = tuple(r for r in RULES if "(?" not in r[0].replace("(?:", "") and "\\2" not in r[0])


def normalised(column: str) -> str:
    """The rules without looking around: the oracle's engine has no such patterns."""
    for pattern, by in (*PLAIN_RULES, COLLAPSE_SPACES):
        by = "".join(f"\\{by[i + 1]}" if c == "$" else "" if i and by[i - 1] == "$" else c for i, c in enumerate(by)) if "$10" not in by else "\\1\\2\\3\\4\\5\\6\\7\\8\\9"
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return column


# The lower-case letters of SLP1 are one glyph each: consonants with a vowel, a vowel, a space, or another character; others follow.
AKSARA = "'(?:[kgcjwqtdnpbmyrlvzsh]+[aiufxeo]?|[aiufxeo]| |[^ aiufxeokgcjwqtdnpbmyrlvzsh])[^ aiufxeokgcjwqtdnpbmyrlvzsh]*'"

CELL_XML = "'<w n=\"' || CAST(n AS VARCHAR) || '\"' || CASE WHEN lemma IS NOT NULL AND lemma <> reading THEN ' lemma=\"' || lemma || '\"' ELSE '' END || '>' || reading || '</w>'"

XML_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10)"


def oracle_sql() -> dict[str, str]:
    out = {
        "fasta_parse": sql("SELECT CAST(passage_id AS VARCHAR) AS passage_id, siglum, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY wit_ord) - 1 AS INTEGER) AS wit_ord, seq FROM seqs", "seqs"),
        "csv_matrix_read": sql("SELECT CAST(passage_id AS VARCHAR) AS passage_id, siglum, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY wit_ord) - 1 AS INTEGER) AS wit_ord, n, reading FROM spaced", "spaced"),
        "tei_matrix_read": sql("SELECT CAST(passage_id AS VARCHAR) AS passage_id, siglum, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY wit_ord) - 1 AS INTEGER) AS wit_ord, n, reading, CASE WHEN lemma <> reading THEN lemma END AS lemma FROM norm", "norm"),
        "tei_matrix_write": sql(f"SELECT passage_id, {XML_HEAD} || '<teiCorpus xmlns=\"http://www.tei-c.org/ns/1.0\">' || chr(10) || string_agg(tei, chr(10) ORDER BY wit_ord) || chr(10) || '</teiCorpus>' AS value FROM (SELECT passage_id, wit_ord, '<TEI n=\"' || siglum || '\"><text>' || string_agg({CELL_XML}, '' ORDER BY n) || '</text></TEI>' AS tei FROM (SELECT passage_id, wit_ord, siglum, n, replace(translate(reading, 'AFNR', 'āṝṅṇ'), 'O', 'au') AS reading, replace(translate(lemma, 'AFNR', 'āṝṅṇ'), 'O', 'au') AS lemma FROM norm) GROUP BY passage_id, wit_ord, siglum) GROUP BY 1", "norm"),
        "csv_matrix_write": sql("SELECT passage_id, string_agg(line, chr(10) ORDER BY wit_ord) AS value FROM (SELECT passage_id, wit_ord, siglum || ',' || string_agg('\"' || reading || '\"', ',' ORDER BY n) AS line FROM spaced GROUP BY passage_id, wit_ord, siglum) GROUP BY 1", "spaced"),
        "apparatus_write": sql(f"""SELECT passage_id, {XML_HEAD} || '<TEI xmlns="http://www.tei-c.org/ns/1.0" n="' || base || '">' || chr(10) || '<teiHeader><fileDesc><sourceDesc><msDesc><msIdentifier><abbr type="siglum">' || base || '</abbr></msIdentifier></msDesc>'
                || chr(10) || '<listWit>' || chr(10) || ws || chr(10) || '</listWit></sourceDesc></fileDesc></teiHeader>' || chr(10) || '<text><body><p>' || body || '</p></body></text></TEI>' AS value FROM
            (SELECT o.passage_id, base, string_agg(CASE WHEN rdgs IS NULL THEN reading ELSE '<app><lem' || CASE WHEN pos <> '' THEN ' wit="' || pos || '"' ELSE '' END || '>' || rtrim(reading, ' ') || '</lem>' || rdgs || '</app>' || CASE WHEN suffix(reading, ' ') THEN ' ' ELSE '' END END, '' ORDER BY o.n) AS body
             FROM spaced o JOIN base ON base.passage_id = o.passage_id AND o.siglum = base LEFT JOIN rdgs ON rdgs.passage_id = o.passage_id AND rdgs.n = o.n GROUP BY 1, 2)
            JOIN (SELECT passage_id, string_agg('<witness xml:id="' || siglum || '"><abbr type="siglum">' || siglum || '</abbr></witness>', chr(10) ORDER BY wit_ord) AS ws FROM (SELECT DISTINCT passage_id, siglum, wit_ord FROM cells) GROUP BY 1) USING (passage_id)""", "rdgs", "base", "spaced"),
        "fasta_write": sql("SELECT passage_id, string_agg('>' || siglum || chr(10) || seq, chr(10) ORDER BY wit_ord) AS value FROM seqs GROUP BY 1", "seqs"),
        "subst_hex": "WITH l AS (SELECT DISTINCT unnest(string_split(l_returnflag || l_linestatus, '')) AS label FROM lineitem), m AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS VARCHAR) AS score FROM lineitem GROUP BY 1, 2) SELECT x.label AS a, y.label AS b, '0x' || hex(x.label) || ' 0x' || hex(y.label) || ' ' || coalesce(score, 'X') AS line FROM l x CROSS JOIN l y LEFT JOIN m ON m.a = x.label AND m.b = y.label",
        "translit_roman": sql(f"SELECT doc_id, md5({replaced('seq', IAST_TO_SLP1)}) AS slp1_md5 FROM texts", "texts"),
        "split_glyphs": sql(f"SELECT doc_id, len({glyphs('seq', all_glyphs(IAST), ' *')}) AS glyphs, md5(array_to_string({glyphs('seq', all_glyphs(IAST), ' *')}, '|')) AS glyphs_md5 FROM texts", "texts"),
        "split_aksaras": sql(f"SELECT doc_id, CAST(len(g) AS INTEGER) AS aksaras, md5(array_to_string(g, '|')) AS aksaras_md5 FROM (SELECT passage_id * 8 + wit_ord AS doc_id, regexp_extract_all(seq, {AKSARA}) AS g FROM seqs)", "seqs"),
        "split_words": sql("SELECT doc_id, len(regexp_extract_all(seq, '[^ ]+ *| +')) AS words, md5(array_to_string(regexp_extract_all(seq, '[^ ]+ *| +'), '|')) AS words_md5 FROM texts", "texts"),
        "normalise_text": sql(f"SELECT doc_id, md5({normalised('seq')}) AS norm_md5 FROM texts", "texts"),
        "detect_script": "SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x{0b80}-\\x{0bff}]') THEN 'tamil' WHEN regexp_matches(t, '[\\x{0900}-\\x{097f}]') THEN 'devanagari' ELSE 'iast' END AS script FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'a', 'अ') WHEN doc_id % 3 = 1 THEN replace(text, 'e', 'எ') ELSE text END AS t FROM documents)",
        "nexus_reading": f"SELECT doc_id, md5(replace({replaced('lower(trim(t))', dict(zip(HK_FROM, HK_TO, strict=True)))}, chr(39), '()')) AS hk_md5 FROM (SELECT doc_id, replace(text, 'e', chr(39)) AS t FROM documents)",
        "pick_reading": sql("SELECT passage_id, siglum, n, coalesce(lemma, reading) AS picked FROM norm", "norm"),
        "span_reading": sql("SELECT passage_id, siglum, wit_ord, trim(regexp_replace(string_agg(reading, ' ' ORDER BY n), '\\s+', ' ', 'g')) AS reading FROM spaced WHERE n BETWEEN 1 AND 4 GROUP BY 1, 2, 3", "spaced"),
        "drop_insignificant": sql("SELECT c.passage_id, c.siglum, c.n, c.reading FROM cells c JOIN cols USING (passage_id, n) WHERE NOT insignificant", "cells", "cols"),
        "gaps_significant": sql("SELECT passage_id, siglum, n, reading FROM marked", "marked"),
        "export_normalised": sql("SELECT passage_id, siglum, n, coalesce(lemma, reading) AS reading FROM norm", "norm"),
        "subst_score": sql("SELECT a.passage_id, a.x AS a, b.x AS b, a.times * b.times AS cells, CAST(CASE WHEN a.x = b.x THEN 1 WHEN a.x IN ('a', 'e', 'i', 'o', 'u') AND b.x IN ('t', 'h', 'n') THEN -1.25 ELSE -1 END AS DOUBLE) AS score FROM letters a JOIN letters b ON a.passage_id = b.passage_id AND a.wit_ord = 0 AND b.wit_ord = 1", "letters"),
        "star_merge_rows": sql(f"SELECT passage_id, 'W' || CAST(wit_ord AS VARCHAR) AS siglum, md5({replaced("replace(seq, ' ', '')", IAST_TO_SLP1)}) AS text_md5, true AS sound FROM copies WHERE passage_id IN (SELECT passage_id FROM copies WHERE seq <> '')", "copies"),
        "collate_words": sql(f"SELECT passage_id, 'W' || CAST(wit_ord AS VARCHAR) AS siglum, md5({replaced('seq', IAST_TO_SLP1)}) AS text_md5, true AS sound FROM copies WHERE passage_id IN (SELECT passage_id FROM copies WHERE seq <> '')", "copies"),
        "collate_aksaras": sql(f"SELECT passage_id, 'W' || CAST(wit_ord AS VARCHAR) AS siglum, md5({replaced('seq', IAST_TO_SLP1)}) AS text_md5, true AS sound FROM copies WHERE passage_id IN (SELECT passage_id FROM copies WHERE seq <> '')", "copies"),
        "pairwise_rescored": sql("SELECT a.passage_id, 'W' || CAST(a.wit_ord AS VARCHAR) AS a, 'W' || CAST(b.wit_ord AS VARCHAR) AS b, true AS sound FROM copies a JOIN copies b ON a.passage_id = b.passage_id AND a.wit_ord < b.wit_ord", "copies"),
        "concat_alignments": sql("""SELECT g.work_id, g.siglum, g.wit_ord, CAST(g.n AS INTEGER) AS n, coalesce(h.reading, '') AS reading FROM
            (SELECT work_id, siglum, wit_ord, unnest(range(CAST(total AS BIGINT))) AS n FROM (SELECT work_id, siglum, CAST(row_number() OVER (PARTITION BY work_id ORDER BY f, w, siglum) - 1 AS INTEGER) AS wit_ord FROM (SELECT work_id, siglum, min(file_ord) AS f, arg_min(wit_ord, file_ord) AS w FROM work GROUP BY 1, 2)) JOIN (SELECT work_id, sum(c) AS total FROM (SELECT work_id, file_ord, max(n) + 1 AS c FROM work GROUP BY 1, 2) GROUP BY 1) USING (work_id)) g
            LEFT JOIN (SELECT w.work_id, w.siglum, w.n + o.offs AS n, w.reading FROM work w JOIN (SELECT work_id, file_ord, coalesce(sum(c) OVER (PARTITION BY work_id ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM (SELECT work_id, file_ord, max(n) + 1 AS c FROM work GROUP BY 1, 2)) o USING (work_id, file_ord)) h ON h.work_id = g.work_id AND h.siglum = g.siglum AND h.n = g.n""", "work"),
        "expand_acpc": sql("SELECT passage_id, s AS siglum, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY wit_ord, s) - 1 AS INTEGER) AS wit_ord, n, reading FROM (SELECT passage_id, coalesce(child, siglum) AS s, wit_ord, n, reading FROM cells LEFT JOIN (VALUES ('W1', 'W1ac'), ('W1', 'W1pc'), ('W5', 'W5ac'), ('W5', 'W5pc')) x(parent, child) ON parent = siglum)", "cells"),
        "missing_witnesses": sql("SELECT f.work_id, f.file_ord, s.siglum, s.first < f.file_ord AS known_before FROM (SELECT DISTINCT work_id, file_ord FROM work) f JOIN (SELECT work_id, siglum, min(file_ord) AS first FROM work GROUP BY 1, 2) s USING (work_id) WHERE (f.work_id, f.file_ord, s.siglum) NOT IN (SELECT work_id, file_ord, siglum FROM work)", "work"),
        "witnesses_in_tree": sql("SELECT passage_id, siglum, n, reading FROM cells WHERE wit_ord < 12", "cells"),
        "base_collation": sql("SELECT passage_id, n, base, base_reading, siglum, variant, agrees FROM coll", "coll"),
        "column_stats": sql("SELECT passage_id, n, r AS readings, k AS kinds, CASE WHEN r < 2 THEN CAST(r AS VARCHAR) ELSE CAST(r AS VARCHAR) || '(' || CAST(k AS VARCHAR) || ')' END AS label FROM (SELECT passage_id, n, count(*) FILTER (WHERE reading <> '') AS r, count(DISTINCT reading) FILTER (WHERE reading <> '') AS k FROM cells GROUP BY 1, 2)", "cells"),
        "empty_columns": sql("SELECT passage_id, n FROM holed GROUP BY 1, 2 HAVING NOT bool_or(reading <> '')", "holed"),
        "empty_rows": sql("SELECT passage_id, siglum FROM holed GROUP BY 1, 2 HAVING NOT bool_or(reading <> '')", "holed"),
        "variant_groups": sql("SELECT passage_id, n, reading, count(*) AS size, string_agg(siglum, ' ' ORDER BY wit_ord) AS sigla FROM cells GROUP BY 1, 2, 3", "cells"),
        "apparatus": sql("SELECT passage_id, n, lemma, spaced, positive, negative FROM app", "app"),
        "merge_columns": sql("SELECT passage_id, siglum, wit_ord, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY t) - 1 AS INTEGER) AS n, reading FROM (SELECT passage_id, siglum, wit_ord, CASE WHEN n IN (2, 3) AND passage_id % 2 = 0 THEN 1 ELSE n END AS t, string_agg(reading, '' ORDER BY n) AS reading FROM cells GROUP BY 1, 2, 3, 4)", "cells"),
        "merge_groups": sql("SELECT passage_id, siglum, wit_ord, n, reading, CASE WHEN norm <> reading THEN norm END AS lemma FROM (SELECT passage_id, siglum, wit_ord, min(n) AS n, string_agg(reading, '' ORDER BY n) AS reading, string_agg(coalesce(nullif(lemma, ''), reading), '' ORDER BY n) AS norm FROM norm JOIN cols USING (passage_id, n) GROUP BY 1, 2, 3, group_id)", "norm", "cols"),
        "binarise": sql("SELECT c.passage_id, c.siglum, c.n, CASE WHEN c.reading <> '' AND s IS NOT NULL THEN '[' || s || ']' ELSE c.reading END AS reading FROM cells c LEFT JOIN (SELECT passage_id, n, arg_min(reading, wit_ord) AS s FROM cells JOIN cols USING (passage_id, n) WHERE \"binary\" AND reading <> '' GROUP BY 1, 2) USING (passage_id, n)", "cells", "cols"),
        "flag_state": sql("SELECT passage_id, bool_and(insignificant) AS insignificant, bool_and(\"binary\") AS \"binary\" FROM cols WHERE n IN (2, 5) AND n % 7 = passage_id % 7 OR n = 2 GROUP BY 1", "cols"),
        "dissolving_groups": sql("SELECT c.passage_id, c.group_id, count(p.n) AS touched, count(*) - count(p.n) AS left_over, count(*) - count(p.n) <= 1 AS dissolves FROM cols c LEFT JOIN picked p USING (passage_id, n) GROUP BY 1, 2 HAVING count(p.n) > 0", "cols", "picked"),
        "matrix_dims": sql("SELECT passage_id, count(DISTINCT siglum) AS ntax, count(DISTINCT n) AS nchar, max(n) AS maxlemma FROM cells GROUP BY 1", "cells"),
        "nexus_states": sql("SELECT passage_id, siglum, n, symbol FROM states", "states"),
        "nexus_labels": sql("SELECT passage_id, n, labels FROM labels", "labels"),
        "nexus_rows": sql("SELECT passage_id, siglum, wit_ord, states FROM rows_", "rows_"),
        "nexus_write": sql("""SELECT b.passage_id, '#NEXUS' || chr(10) || chr(10) || 'BEGIN TAXA;' || chr(10) || '  DIMENSIONS NTAX=' || ntax || ';' || chr(10) || '  TAXLABELS ' || taxa || ';' || chr(10) || 'END;' || chr(10) || chr(10) || 'BEGIN CHARACTERS;' || chr(10) || '  DIMENSIONS NCHAR=' || nchar || ';' || chr(10)
                || '  FORMAT DATATYPE=STANDARD RESPECTCASE GAP=- MISSING=? SYMBOLS="0 1 2 3 4 5 6 7 8 9 A B C D E F G H K L M N P Q R S T U V W X Y Z a b c d e f g h k l m n p q r s t u v w x y z";' || chr(10) || '  CHARSTATELABELS' || chr(10) || lab || chr(10) || ';' || chr(10) || 'MATRIX' || chr(10) || matrix || chr(10) || ';' || chr(10) || 'END;' || chr(10) AS value
            FROM (SELECT passage_id, count(*) AS ntax, max(length(states)) AS nchar, string_agg(chr(39) || siglum || chr(39) || ' ' || states, chr(10) ORDER BY wit_ord) AS matrix, string_agg(chr(39) || siglum || chr(39), ' ' ORDER BY wit_ord) AS taxa FROM (SELECT passage_id, siglum, wit_ord, string_agg(symbol, '' ORDER BY n) AS states FROM states GROUP BY 1, 2, 3) GROUP BY 1) b
            LEFT JOIN (SELECT passage_id, string_agg(CAST(n + 1 AS VARCHAR) || ' / ' || labels, ',' || chr(10) ORDER BY n) AS lab FROM labels GROUP BY 1) USING (passage_id)""", "states", "labels"),
        "renumber_columns": sql("SELECT passage_id, siglum, wit_ord, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY n) - 1 AS INTEGER) AS n, reading FROM cells WHERE (passage_id + n) % 4 <> 0", "cells"),
        "group_by_whitespace": sql("""SELECT passage_id, n, CASE WHEN g IS NOT NULL THEN g WHEN count(*) FILTER (WHERE g IS NULL) OVER (PARTITION BY passage_id, run) >= 2 THEN min(n) FILTER (WHERE g IS NULL) OVER (PARTITION BY passage_id, run) END AS group_id FROM
            (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY passage_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (SELECT c.passage_id, c.n, CASE WHEN c.n = 4 AND c.passage_id % 2 = 0 THEN 4 END AS g, coalesce(r >= 0.5, false) OR lead(c.n) OVER (PARTITION BY c.passage_id ORDER BY c.n) IS NULL OR (c.n = 4 AND c.passage_id % 2 = 0) AS ends FROM cols c LEFT JOIN (SELECT passage_id, n, avg(CASE WHEN suffix(reading, ' ') THEN 1.0 ELSE 0.0 END) AS r FROM spaced WHERE reading <> '' GROUP BY 1, 2) USING (passage_id, n)))""", "cols", "spaced"),
        "group_position": sql("SELECT passage_id, n, group_id, CASE WHEN row_number() OVER w = 1 THEN 'start' WHEN row_number() OVER w = count(*) OVER (PARTITION BY passage_id, group_id) THEN 'end' ELSE 'internal' END AS position FROM cols WINDOW w AS (PARTITION BY passage_id, group_id ORDER BY n)", "cols"),
        "nearest_nonempty": sql("SELECT passage_id, siglum, n, last_value(CASE WHEN reading <> '' THEN n END IGNORE NULLS) OVER (PARTITION BY passage_id, siglum ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before, first_value(CASE WHEN reading <> '' THEN n END IGNORE NULLS) OVER (PARTITION BY passage_id, siglum ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM cells", "cells"),
        "column_bounds": sql("SELECT passage_id, min(n) AS low, CASE WHEN count(*) > 1 THEN max(n) END AS high FROM picked GROUP BY 1", "picked"),
        "move_row": sql("SELECT passage_id, siglum, n, reading, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY k) - 1 AS INTEGER) AS wit_ord FROM (SELECT *, CASE WHEN passage_id % 3 = 0 AND wit_ord = max(wit_ord) OVER (PARTITION BY passage_id) THEN -0.5 ELSE wit_ord END AS k FROM cells)", "cells"),
        "tree_levels": "SELECT t.tree_id, CAST(i AS INTEGER) AS node_id, CASE WHEN i >= 16 THEN 0 WHEN i >= 8 THEN 1 WHEN i >= 4 THEN 2 WHEN i >= 2 THEN 3 ELSE 4 END AS level FROM range(1, 32) r(i), (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 160) AS BIGINT) AS VARCHAR) AS tree_id FROM customer) t",
        "tree_paths": sql("SELECT t.tree_id, a, b, CAST(edges AS INTEGER) AS edges, round(length, 6) AS length FROM paths, (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 160) AS BIGINT) AS VARCHAR) AS tree_id FROM customer) t", "paths"),
        "tree_diameter": "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || '-' || CAST(CAST(floor(c_custkey / 160) AS BIGINT) AS VARCHAR) AS tree_id, 8 AS diameter FROM customer",
        "variant_spread": sql("""SELECT passage_id, n, reading, CAST(len(wits) AS INTEGER) AS witnesses, CASE WHEN len(wits) = 1 THEN 0 ELSE CAST(e AS INTEGER) END AS spread, round(CASE WHEN len(wits) = 1 THEN 0.0 ELSE l END, 6) AS branch, round(CASE WHEN len(wits) = 1 THEN 1.0 ELSE e END / 8, 6) AS ratio
            FROM (SELECT c.passage_id, c.n, c.reading, list(DISTINCT c.siglum) AS wits, max(p.edges) AS e, arg_max(p.length, (p.edges, p.length)) AS l FROM cells c LEFT JOIN cells d ON d.passage_id = c.passage_id AND d.n = c.n AND d.reading = c.reading AND c.siglum < d.siglum LEFT JOIN paths p ON p.a = c.siglum AND p.b = d.siglum GROUP BY 1, 2, 3)""", "cells", "paths"),
        "insert_columns": sql("SELECT passage_id, siglum, wit_ord, CAST(n + CASE WHEN n > 2 THEN 2 ELSE 0 END + CASE WHEN n > 4 THEN 1 ELSE 0 END AS INTEGER) AS n, reading FROM cells UNION ALL SELECT DISTINCT passage_id, siglum, wit_ord, CAST(k AS INTEGER), '' FROM cells, (VALUES (3), (4), (7)) x(k)", "cells"),
        "delete_columns": sql("SELECT passage_id, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY n) - 1 AS INTEGER) AS n, CASE WHEN NOT hit THEN group_id END AS group_id FROM (SELECT c.*, p.n IS NULL AS stays, bool_or(p.n IS NOT NULL) OVER (PARTITION BY c.passage_id, c.group_id) AS hit FROM cols c LEFT JOIN picked p USING (passage_id, n)) WHERE stays", "cols", "picked"),
        "delete_empty_columns": sql("SELECT passage_id, siglum, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY n) - 1 AS INTEGER) AS n, reading FROM (SELECT *, bool_or(reading <> '') OVER (PARTITION BY passage_id, n) AS held FROM holed) WHERE held", "holed"),
        "set_groups": sql("SELECT passage_id, n, CASE WHEN n BETWEEN 1 AND 3 AND passage_id % 2 = 0 THEN 100 WHEN n BETWEEN 0 AND 2 AND passage_id % 2 = 1 THEN NULL ELSE group_id END AS group_id FROM cols", "cols"),
        "set_flags": sql("SELECT passage_id, n, CASE WHEN (passage_id + n) % 4 = 0 THEN true ELSE insignificant END AS insignificant, \"binary\" FROM cols", "cols"),
        "apply_cell_edits": sql("SELECT passage_id, siglum, n, CASE WHEN e THEN 'ZZ' ELSE reading END AS reading, CASE WHEN NOT e THEN lemma END AS lemma, e AND siglum = 'W3' AS emended FROM (SELECT *, (passage_id + wit_ord + n) % 97 = 0 AS e FROM norm)", "norm"),
        "add_row": sql("SELECT passage_id, siglum, wit_ord, n, reading FROM cells UNION ALL SELECT passage_id, 'new', max(max(wit_ord)) OVER (PARTITION BY passage_id) + 1, n, '' FROM cells GROUP BY passage_id, n", "cells"),
        "delete_rows": sql("SELECT passage_id, siglum, CAST(dense_rank() OVER (PARTITION BY passage_id ORDER BY wit_ord) - 1 AS INTEGER) AS wit_ord, n, reading FROM cells WHERE (passage_id + wit_ord) % 5 <> 0", "cells"),
        "delete_empty_rows": sql("SELECT passage_id, siglum, n, reading FROM (SELECT *, bool_or(reading <> '') OVER (PARTITION BY passage_id, siglum) AS held FROM holed) WHERE held", "holed"),
        "variant_texts": sql("SELECT passage_id, w AS siglum, trim(regexp_replace(string_agg(CASE WHEN list_contains(wits, w) THEN text ELSE '' END, '' ORDER BY seg_no), '\\s+', ' ', 'g')) AS text FROM segs, (VALUES ('A'), ('B'), ('C')) x(w) GROUP BY 1, 2", "segs"),
        "passage_defaults": """WITH said AS (
                SELECT lpad(CAST(conv_id // 8 AS VARCHAR), 12, '0') AS doc_id, 'p' || CAST(conv_id % 8 AS VARCHAR) AS passage_id, string_agg(text, ' ' ORDER BY turn) AS t
                FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)
            SELECT doc_id, passage_id, md5(regexp_replace(t, '[\\x00-\\x20]+', '', 'g')) AS text_md5 FROM said
            WHERE t <> '' AND passage_id IN (SELECT passage_id FROM said WHERE doc_id = (SELECT min(doc_id) FROM said))""",
        "passage_select": sql("SELECT passage_id, seg_no, kind, text FROM segs WHERE passage_id IN (SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 2)", "segs"),
        "align_zip": sql("SELECT passage_id, siglum, n, reading, CASE WHEN upper(substr(reading, 1, 1)) <> reading THEN upper(substr(reading, 1, 1)) END AS lemma FROM (SELECT passage_id, siglum, n, reading FROM cells)", "cells"),
    }
    # Scores that SQL can give: equal first words' lengths between two witnesses of a passage.
    out["center_witness"] = sql("""SELECT passage_id, arg_max(s, (total, -o)) AS center, max(total) AS total FROM (SELECT passage_id, s, o, sum(score) AS total FROM (SELECT a.passage_id, unnest([a.siglum, b.siglum]) AS s, unnest([a.wit_ord, b.wit_ord]) AS o, CAST(-abs(length(a.seq) - length(b.seq)) AS DOUBLE) AS score FROM seqs a JOIN seqs b ON a.passage_id = b.passage_id AND a.wit_ord < b.wit_ord) GROUP BY 1, 2, 3) GROUP BY 1""", "seqs")
    for name, view in (("fitch_up", "up_sets"), ("fitch_down", "down_sets")):
        out[name] = sql(f"SELECT passage_id, n, node_id, {SORTED} AS states FROM {view}", view)
    out["format_states"] = sql(f"SELECT passage_id, n, node_id, {SHOWN} AS shown FROM up_sets", "up_sets")
    out["reconstruct_all"] = sql(f"SELECT passage_id, n, node_id, {LISTED} AS reading FROM down_sets", "down_sets")
    out["reconstruct_node"] = sql(f"""SELECT passage_id, 'ω2' AS siglum, wit_ord, n, CASE WHEN len(u) = 1 THEN u[1] ELSE {SHOWN} END AS reading, 'reconstructed' AS row_type
        FROM (SELECT passage_id, n, s FROM down_sets WHERE node_id = '2') JOIN (SELECT passage_id, n, s AS u FROM up_sets WHERE node_id = '2') USING (passage_id, n)
        JOIN (SELECT passage_id, max(wit_ord) + 1 AS wit_ord FROM cells GROUP BY 1) USING (passage_id)""", "up_sets", "down_sets", "cells")
    out["export_pipeline"] = sql(""", g AS (SELECT passage_id, group_id, bool_and(insignificant) AS i, bool_and("binary") AS b FROM cols GROUP BY 1, 2),
        m AS (SELECT passage_id, siglum, wit_ord, group_id, min(n) AS n, string_agg(coalesce(lemma, reading), '' ORDER BY n) AS reading FROM norm JOIN cols USING (passage_id, n) GROUP BY 1, 2, 3, 4),
        k AS (SELECT passage_id, siglum, wit_ord, n, reading, b FROM m JOIN g USING (passage_id, group_id) WHERE NOT i),
        f AS (SELECT passage_id, n, arg_min(reading, wit_ord) AS state FROM k WHERE b AND reading <> '' GROUP BY 1, 2)
        SELECT passage_id, siglum, n, CASE WHEN reading = '' THEN '[]' WHEN state IS NOT NULL THEN '[' || state || ']' ELSE reading END AS reading FROM k LEFT JOIN f USING (passage_id, n)""", "norm", "cols")
    out["subst_matrix"] = """WITH c AS (SELECT year(l_shipdate) AS y, lower(l_returnflag) AS a, lower(l_linestatus) AS b, count(*) AS score FROM lineitem GROUP BY 1, 2, 3),
        r AS (SELECT y, a, max(score) FILTER (WHERE b = 'f') AS f, max(score) FILTER (WHERE b = 'o') AS o FROM c GROUP BY 1, 2)
        SELECT CAST(y AS VARCHAR) AS path, a, 'f' AS b, CAST(coalesce(f, 0) AS DOUBLE) AS score FROM r UNION ALL SELECT CAST(y AS VARCHAR), a, 'o', CAST(coalesce(o, 0) AS DOUBLE) FROM r"""
    out["tree_reroot"] = f"""SELECT tree_id, CASE WHEN i = 3 THEN 'fakeroot' ELSE CAST(i // 2 AS VARCHAR) END AS source, CAST(i AS VARCHAR) AS target, round(CAST(0.01 * ((i * 7) % 13) AS DOUBLE), 6) AS length FROM range(3, 32) r(i), {TREES}
        UNION ALL SELECT tree_id, 'fakeroot', '2', CAST(0 AS DOUBLE) FROM {TREES}"""
    # In the file, a tree's edges stand behind its 31 nodes.
    out["tree_read"] = f"SELECT tree_id, 'e' || CAST(i AS VARCHAR) AS edge_id, CAST(i + 29 AS INTEGER) AS edge_ord, CAST(i // 2 AS VARCHAR) AS source, CAST(i AS VARCHAR) AS target, CAST(0.01 AS DOUBLE) * ((i * 7) % 13) AS length FROM range(2, 32) r(i), {TREES}"
    # The lines of the files whose whole texts the queries of the writers give.
    for name, written in (("tei_matrix_lines", "tei_matrix_write"), ("csv_matrix_lines", "csv_matrix_write"), ("nexus_lines", "nexus_write")):
        out[name] = f"SELECT passage_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT passage_id, string_split(value, chr(10)) AS l FROM ({out[written]}))"
    out["fasta_lines"] = sql("SELECT passage_id, CAST(row_number() OVER (PARTITION BY passage_id ORDER BY wit_ord, k DESC) AS INTEGER) AS line_no, CASE WHEN k = 1 THEN '>' || siglum ELSE seq END AS line FROM seqs, (VALUES (1), (0)) v(k)", "seqs")
    return out
