"""Transliteration and tokens of romanised and Indic scripts, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs of two roman schemes, place by place, and of the scheme that names states.
IAST = {
    "vowels": "a ā i ī u ū ṛ ṝ ḷ ḹ ẽ e ai õ o au ê ô aî aû".split(),
    "consonants": "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ ḻh ṙ".split(),
    "marks": "ṃ ḥ m̐ oṁ oḿ".split(),
}
SLP1 = {
    "vowels": "a A i I u U f F x X ẽ e E õ o O ê ô aî aû".split(),
    "consonants": "k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h L LL ṙ".split(),
    "marks": "M H m̐ oṁ oḿ".split(),
}
HK_FROM = "a ā i ī u ū ṛ ṝ l̥ l̥̄ e ē ai o ō au ê aî ô aû ṃ ḥ m̐ ẖ ḫ ḵ k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḷ ḻ ṟ ṉ oṁ oḿ".split()
HK_TO = "a A i I u U R RR lR lRR e E ai o O au e ai o au M H M H H H k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h L zh _r _n om om".split()

# Roman letters in the order of the Unicode blocks of Indic scripts, with their offsets in a block.
INDIC_VOWELS = dict(zip("a ā i ī u ū ṛ l̥ e ē ai o ō au ṝ l̥̄".split(), (0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0B, 0x0C, 0x0E, 0x0F, 0x10, 0x12, 0x13, 0x14, 0x60, 0x61), strict=True))
INDIC_MARKS = dict(zip("ā i ī u ū ṛ ṝ e ē ai o ō au l̥ l̥̄".split(), (0x3E, 0x3F, 0x40, 0x41, 0x42, 0x43, 0x44, 0x46, 0x47, 0x48, 0x4A, 0x4B, 0x4C, 0x62, 0x63), strict=True))
INDIC_CONSONANTS = dict(zip("k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n ṉ p ph b bh m y r ṟ l ḷ ḻ v ś ṣ s h".split(), range(0x15, 0x3A), strict=True))
INDIC_OTHER = {"m̐": 0x01, "ṃ": 0x02, "ḥ": 0x03, "'": 0x3D} | {str(i): 0x66 + i for i in range(10)}
VIRAMA = 0x4D
BLOCKS = {"devanagari": 0x900, "bengali": 0x980, "tamil": 0xB80, "telugu": 0xC00, "malayalam": 0xD00}
DANDAS = {"|": "।", "||": "॥"}
# Letters that Tamil script borrows from the Grantha block (offsets are the same), and its further signs.
GRANTHA = 0x11300
BORROWED = frozenset("kh g gh ch jh ṭh ḍ ḍh th d dh ph b bh ṛ ṝ l̥ l̥̄ m̐ ṃ ḥ '".split())
TAMIL_OTHER = {"ẖ": "", "ḫ": "", "ḵ": "ஃ", "oṁ": "ௐ", "oḿ": "", "⁰": "௰", "⁰⁰": "௱", "⁰⁰⁰": "௲"}


def all_glyphs(scheme: dict[str, list[str]]) -> list[str]:
    return scheme["vowels"] + scheme["consonants"] + scheme["marks"]


def alternatives(glyphs: list[str]) -> str:
    """A pattern for the longest glyph at a place."""
    return "|".join(re.escape(g) for g in sorted(set(glyphs), key=lambda g: (-len(g), g)))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tokens(text: Column, glyphs: list[str], tail: str = "") -> Column:
    """Glyphs of a text, longest first; other characters stand alone, as single ones do without being named."""
    long = [g for g in glyphs if len(g) > 1]
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{alternatives(long)}|.){tail}" if long else f"(?s).{tail}"), F.lit(0))


#: Private characters that stand for glyphs during a replacement: nothing else reads or writes them.
PRIVATE = 0xE800


def replace_glyphs(text: Column, pairs: dict[str, str]) -> Column:
    """Glyphs by their counterparts, longest first.

    Long glyphs become private characters, one translation does the single ones, and private characters become their
    counterparts: whole-text operations instead of an array of glyphs. Texts that hold such characters, and tables with
    glyphs that overlap each other, go glyph by glyph.
    """
    table = literal_map(pairs)
    by_glyph = F.array_join(F.transform(tokens(text, list(pairs)), lambda t: F.coalesce(F.try_element_at(table, t), t)), "")
    long = sorted((g for g in pairs if len(g) > 1), key=lambda g: (-len(g), g))
    overlap = any(a[-k:] == b[:k] for a in long for b in long for k in range(1, min(len(a), len(b))) if a != b or k < len(a))
    if overlap:
        return by_glyph
    held = {g: chr(PRIVATE + i) for i, g in enumerate([*long, *(g for g in pairs if len(g) == 1 and len(pairs[g]) != 1)])}
    made = text
    for g in long:
        made = F.replace(made, F.lit(g), F.lit(held[g]))
    single = {g: held.get(g, pairs[g]) for g in pairs if len(g) == 1} | {held[g]: pairs[g] for g in long if len(pairs[g]) == 1}
    made = F.translate(made, "".join(single), "".join(single.values()))
    for g, c in held.items():
        if len(pairs[g]) != 1:
            made = F.replace(made, F.lit(c), F.lit(pairs[g]))
    return F.when(text.rlike(f"[\\x{{{PRIVATE:x}}}-\\x{{{PRIVATE + len(held):x}}}]"), by_glyph).otherwise(made)


IAST_TO_SLP1 = dict(zip(all_glyphs(IAST), all_glyphs(SLP1), strict=True))
SLP1_TO_IAST = dict(zip(all_glyphs(SLP1), all_glyphs(IAST), strict=True))


def iast_to_slp1(text: Column) -> Column:
    return replace_glyphs(text, IAST_TO_SLP1)


def slp1_to_iast(text: Column) -> Column:
    return replace_glyphs(text, SLP1_TO_IAST)


def split_glyphs(text: Column, scheme: dict[str, list[str]] = SLP1, spaces_apart: bool = False) -> Column:
    """Glyphs, each with the spaces behind it, or with spaces as glyphs of their own."""
    return tokens(text, all_glyphs(scheme), "" if spaces_apart else " *")


def split_aksaras(text: Column, scheme: dict[str, list[str]] = SLP1) -> Column:
    """Syllables: a unit starts at a space, at a vowel not behind a consonant, at a consonant not behind a consonant,
    and at a mark not behind a vowel; anything else joins the unit before it. Read as states over the glyphs."""
    glyphs = split_glyphs(text, scheme, spaces_apart=True)

    def of(g: Column) -> Column:
        return F.when(g == " ", "S").when(g.isin(scheme["vowels"]), "V").when(g.isin(scheme["consonants"]), "C").when(g.isin(scheme["marks"]), "M").otherwise("O")


    # A break mark (a character no text holds) before each glyph that starts a unit; then one join and split.
    def marked(all_: Column) -> Column:
        def piece(g: Column, i: Column) -> Column:
            now, before = of(g), F.when(i > 0, of(F.get(all_, i - 1))).otherwise(F.lit("S"))
            starts = (now == "S") | ((now == "V") & (before != "C")) | ((now == "C") & (before != "C")) | ((now == "M") & (before != "V"))
            return F.when((i > 0) & starts, F.concat(F.lit("\x00"), g)).otherwise(g)

        return F.transform(all_, piece)

    joined = F.element_at(F.transform(F.array(glyphs), lambda a: F.array_join(marked(a), "")), 1)
    return F.filter(F.split(joined, "\x00"), lambda x: x != "")


def split_words(text: Column) -> Column:
    """Words, each with the run of spaces behind it; leading spaces are a token."""
    return F.regexp_extract_all(text, F.lit("[^ ]+ *| +"), F.lit(0))


def detect_script(text: Column) -> Column:
    """The first of these scripts that occurs; else IAST."""
    ranges = (("tamil", "[\\x{0b80}-\\x{0bff}]"), ("devanagari", "[\\x{0900}-\\x{097f}]"), ("bengali", "[\\x{0980}-\\x{09ff}]"), ("telugu", "[\\x{0c00}-\\x{0c7f}]"), ("malayalam", "[\\x{0d00}-\\x{0d7f}]"))
    out = F.when(text.rlike(ranges[0][1]), ranges[0][0])
    for name, pattern in ranges[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("iast")


def nexus_reading(reading: Column) -> Column:
    """The name of a state: trimmed, lower case, Harvard-Kyoto, apostrophes as brackets."""
    return F.replace(replace_glyphs(F.lower(F.trim(reading)), dict(zip(HK_FROM, HK_TO, strict=True))), F.lit("'"), F.lit("()"))


def _block(script: str, offsets: dict[str, int]) -> dict[str, str]:
    return {roman: chr((GRANTHA if script == "tamil" and roman in BORROWED else BLOCKS[script]) + o) for roman, o in offsets.items()}


#: Pieces of text that a worker remembers of each script, and the longest of them.
REMEMBERED, LONGEST = 100_000, 48


class Pieces(dict):
    """Spellings of a text's pieces (about a syllable each), worked out once while they are remembered.

    ``cut`` matches pieces, end to end, whose spellings don't depend on one another.
    """

    def __init__(self, cut: str, spell: Callable[[str], str]):
        super().__init__()
        self.cut, self.spell = re.compile(f"(?s){cut}"), spell

    def __missing__(self, piece: str) -> str:
        made = self.spell(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = made
        return made

    def text(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.cut.findall(text)))


@cache
def _pieces(script: str, to: str) -> Pieces:
    """A worker's pieces, over its tasks."""
    return _roman_pieces(script) if to == "roman" else _tamil_pieces() if script == "tamil" else _indic_pieces(script)


def _mapped(text: Column, f: Callable[[pa.Array], list[str | None]]) -> Column:
    """Texts in Arrow batches; nulls stay nulls."""

    def go(texts: pa.Array) -> pa.Array:
        return pa.array(f(texts), pa.string())

    return F.arrow_udf(go, "string")(text)


def _by_pieces(text: Column, script: str, to: str = "indic") -> Column:
    return _mapped(text, lambda texts: [None if t is None else _pieces(script, to).text(t) for t in texts.to_pylist()])


def _roman_pieces(script: str) -> Pieces:
    """A piece is a cluster of consonants with the signs behind it, or what stands between such."""
    letters = {v: k for k, v in (_block(script, INDIC_VOWELS) | _block(script, INDIC_CONSONANTS) | _block(script, INDIC_OTHER) | DANDAS).items()}
    virama = chr(BLOCKS[script] + VIRAMA)
    marks = {v: k for k, v in _block(script, INDIC_MARKS).items()} | {virama: ""}
    table, consonants = letters | marks, "".join(_block(script, INDIC_CONSONANTS).values())

    def spell(piece: str) -> str:
        out = [table.get(t, t) + "a" if t in consonants and after not in marks else table.get(t, t) for t, after in zip(piece, [*piece[1:], ""], strict=False)]
        return "".join(out).replace("\u200d", "")

    return Pieces(f"(?:[{consonants}]{virama})*[{consonants}][{''.join(marks)}]*|[^{consonants}]+", spell)


def indic_to_roman(text: Column, script: str) -> Column:
    """A consonant is followed by ``a`` unless a vowel mark or virama follows; joiners go."""
    if script == "devanagari":
        c = "".join(_block(script, INDIC_CONSONANTS).values())
        text = F.regexp_replace(F.regexp_replace(text, f"(?<=[{c}])([इउ])", "_$1"), f"([{c}]्)(?=\\s|$)", "$1_")
    return _by_pieces(text, script, "roman")


# Where words of a roman text run together in an Indic script.
JOINS = (
    ("([ḍdrmvynhs]) ([aāiīuūṛeoéó])", "$1$2"),
    ("([kgcjṭḍtdpb]) h", "$1‌h"),
    ("([kgcjñḍtdnpbmrlyvśṣsṙ]) ([kgcjṭḍtdnpbmyrlvśṣshḻ])", "$1$2"),
    ("([oóeéā]) ([ṃ'])", "$1$2"),
    ("^ṃ", "'‍ṃ"),
    ("^ḥ", "'‍ḥ"),
    ("^_y", "'‍y"),
    ("ü", "‌u"),
    ("ï", "‌i"),
    ("__", "‍"),
    ("_", "‌"),
)
# Malayalam letters for consonants at the end of a word.
CHILLU = {"ക": "ൿ", "ത": "ൽ", "ന": "ൻ", "മ": "ൔ", "ര": "ർ"}


# Letters for consonants at the end of a word in manuscripts' Grantha; display fonts hold them in private places.
GRANTHA_FINALS = {"സ": "\ue1d3", "ര": "\u0d7c", "യ": "\ue1cb", "ച": "\ue1b6", "ദ": "\ue1c2", "ശ": "\ue1d2"}
# Vowel signs of Tamil that become those of the Grantha block behind a borrowed consonant.
TAMIL_SIGNS = {
    "\u0b82": "\U00011300", "\u0bbe": "\U0001133e", "\u0bbf": "\U0001133f", "\u0bc0": "\U00011340", "\u0bc1": "\U00011341", "\u0bc2": "\U00011342", "\u0bc6": "\U00011347",
    "\u0bc7": "\U00011347", "\u0bc8": "\U00011348", "\u0bca": "\U0001134b", "\u0bcb": "\U0001134b", "\u0bcc": "\U0001134c", "\u0bcd": "\U0001134d", "\u0bd7": "\U00011357",
}


#: A piece of a roman text ends behind vowels: what a letter becomes depends on consonants before it and on what is behind a consonant.
VOWELS = "".join(sorted({c for g in INDIC_VOWELS for c in g} - {"l"}))


def _spelt(block: str, other: dict[str, str]) -> Callable[[str], str]:
    """Letters of a block for roman ones: a vowel behind a consonant is a mark (``a`` none), anything else there, and the end, calls for a virama."""
    vowels, consonants = _block(block, INDIC_VOWELS), _block(block, INDIC_CONSONANTS)
    letters = vowels | consonants | _block(block, INDIC_OTHER) | DANDAS | other
    marks, virama = _block(block, INDIC_MARKS) | {"a": ""}, chr(BLOCKS[block] + VIRAMA)
    glyph = re.compile(f"(?s){alternatives([g for g in letters if len(g) > 1])}|.")

    def spell(piece: str) -> str:
        out, behind = [], False
        for t in glyph.findall(piece):
            letter = letters.get(t, t)
            out.append(marks.get(t, virama + letter) if behind else letter)
            behind = t in consonants
        return "".join(out) + virama if behind else "".join(out)

    return spell


def _cut(more: str = "") -> str:
    return f"[^{VOWELS}{more}]*[{VOWELS}{more}]+|[^{VOWELS}{more}]+"


def _indic_pieces(script: str) -> Pieces:
    """Pieces in a script but Tamil, with the letters that stand at a word's end."""
    block = "malayalam" if script == "grantha" else script
    spelt = _spelt(block, {})
    if script == "devanagari":
        return Pieces(_cut(), lambda piece: spelt(piece).replace("¯", "ꣻ"))
    if block != "malayalam":
        return Pieces(_cut(), spelt)
    finals, before = (GRANTHA_FINALS, "[^\u200c ,—’―]") if script == "grantha" else (CHILLU, "[^\\s\u200c,—’―]")
    rules = [(re.compile("(^|[^്])ര്(?=\\S)", re.ASCII), "\\1ൎ"), *((re.compile(f"{plain}്(?!{before})", re.ASCII), final) for plain, final in finals.items())]
    narrow = str.maketrans("ṁḿíúé", "ṃṃiue")

    def spell(piece: str) -> str:
        made = spelt(piece.translate(narrow))
        for pattern, by in rules:
            made = pattern.sub(by, made)
        return made.replace("ക്ഷി", "க்ஷி") if script == "grantha" else made

    return Pieces(_cut("íúé"), spell)


def _tamil_pieces() -> Pieces:
    spelt = _spelt("tamil", TAMIL_OTHER)
    borrowed = "".join(_block("tamil", {c: o for c, o in INDIC_CONSONANTS.items() if c in BORROWED}).values())
    sign = re.compile(f"(?<=[{borrowed}])[{''.join(TAMIL_SIGNS)}]")
    return Pieces(_cut("ṁḿ"), lambda piece: sign.sub(lambda m: TAMIL_SIGNS[m[0]], spelt(piece)))


def roman_to_tamil(text: Column) -> Column:
    """Tamil script with Grantha letters where it has none; a capital vowel or ``·`` inside a word keeps its letter apart from the one before."""
    text = F.regexp_replace(text, r"([kṅcñṭṇtnpmyrlvḻḷṟṉ])\s+([aāiīuūeēoō])", "$1$2")
    text = F.regexp_replace(text, r"(^|\s)_ā", "$1அ\u200dா")
    text = F.regexp_replace(F.regexp_replace(text, r"(\S)([AĀIĪUŪEĒOŌ])", "$1\u200c$2"), r"(\S)·", "$1\u200c")
    return _by_pieces(F.lower(text), "tamil")


#: The joins that need a search; the others are plain replacements.
_JOINS = [(re.compile(p) if re.search(r"[\[^]", p) else p, re.sub(r"\$(\d)", r"\\\1", by)) for p, by in JOINS]


def _joined(text: str) -> str:
    """Words of a roman text run together."""
    for pattern, by in _JOINS:
        text = text.replace(pattern, by) if isinstance(pattern, str) else pattern.sub(by, text)
    return text


#: The last batch that was joined: a query's scripts take the same texts one after another.
_LAST: list = [None, None]


def _batch_joined(texts: pa.Array, start: str) -> list[str | None]:
    """Joined texts of a batch; ``start``: what a text begins with for ``_ā``."""
    if _LAST[0] is None or not texts.equals(_LAST[0]):
        _LAST[:] = texts, [None if t is None else _joined(t) for t in texts.to_pylist()]
    out = _LAST[1]
    special = pc.fill_null(pc.starts_with(texts, "_ā"), False)
    if pc.any(special).as_py():
        out = [_joined(start + t[2:]) if s else j for t, j, s in zip(texts.to_pylist(), out, special.to_pylist(), strict=True)]
    return out


def _indic_batch(texts: pa.Array, script: str, start: str) -> list[str | None]:
    pieces = _pieces(script, "indic")
    return [None if t is None else pieces.text(t) for t in _batch_joined(texts, start)]


def roman_to_indic(text: Column, script: str) -> Column:
    """A romanised text in devanagari, telugu, malayalam, grantha (letters of the Malayalam block, as its fonts take them), tamil or bengali.

    Words run together where the script writes them so; vowels behind a consonant become marks (``a`` none); a consonant with no
    vowel behind it gets a virama. A null stays null.
    """
    if script == "tamil":
        return roman_to_tamil(text)
    block = "malayalam" if script == "grantha" else script
    text = F.lower(F.replace(text, F.lit("ṙ"), F.lit("r\u200d" if script == "telugu" else "r")))
    start = f"{chr(BLOCKS[block] + INDIC_OTHER["'"])}\u200d{chr(BLOCKS[block] + INDIC_MARKS['ā'])}"
    return _mapped(text, lambda texts: _indic_batch(texts, script, start))
