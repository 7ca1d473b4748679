"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with its root-to-leaf path of block tags. Per path: text length outside links, punctuation
marks, and nodes. The two ratios (text per node, punctuation per node) are fused and smoothed along the page among
siblings; what tag names, roles and classes say (menus, adverts, forms, comments; articles) is one more factor of a
path's score. Paths whose score reaches a share of the best one and of the spread over the page are content, and their
blocks are the text. Short blocks that paragraphs surround (headings, list items, cells, captions) come with them.

So names alone never choose a block: a link box or a list of remarks inside an article falls by its ratios, and a page
that names nothing is read by its ratios alone. A list that ends an article falls too if it is as short as remarks are.

Defined results: null or empty html, or a page without content, gives empty text; broken or cut-off markup is read to
its end; ids may be null or repeated (one row out for each row in); other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z|</[^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)

# Fixed values of HTML: elements without content, of raw text, and of running text inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes textarea xmp template svg math object audio video canvas select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img picture source input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Elements that hold no article text.
OUT = frozenset("nav aside footer form head button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark the same.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar sidenav aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login register share sharing social related recommended comment comments commentlist disqus respond reply replies "
    "widget toolbar pager pagination search skip copyright disclaimer form".split()
)
#: The same for elements that may name their whole page's parts.
HOLDER_MARKS = frozenset("ad ads advert advertisement comment comments promo related reply sponsored".split())
HOLDERS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose short blocks belong to the paragraphs around them.
FILLED = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre".split())
#: Share of the best score that such blocks need above and below all paragraphs.
OF_FILLED = 0.05
#: Factor of a path's score for elements named as no article text, and for articles; least score of content.
MARKED, HELD, LEAST = 0.0005, 10.0, 1.0
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Block(NamedTuple):
    """``path`` joins block tags, with ``!`` behind those named as no article text; ``chain`` numbers these elements."""

    path: str
    chain: tuple[int, ...]
    text: str
    linked: int


#: Signs behind a tag in a path: no article text by its name; not shown at all.
NAMED, HIDDEN = "!", "?"


def _outside(name: str, attributes: str, in_holder: bool) -> str:
    """The sign of an element, empty for most."""
    kind = NAMED if name in OUT or name == "header" and not in_holder else ""
    if name == "head":
        return HIDDEN
    if not attributes or name in ("html", "body"):
        return kind
    marks = HOLDER_MARKS if name in HOLDERS else MARKS
    for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        if bare or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return HIDDEN
        if key == "role" and value in ROLES or key in ("class", "id") and marks & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())):
            kind = NAMED
    return kind


def blocks(page: str) -> tuple[list[Block], dict[int, str]]:
    """The text blocks of a page, in page order; tag by element number. Hidden elements, scripts and styles have none."""
    stack: list[tuple[str, str, int]] = [("", "", 0)]  # tag, path's name of it, element
    tags = {0: ""}
    found: list[Block] = []
    parts: list[str] = []
    linked = links = holders = hidden = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not hidden:
                shown = [x for x in stack if x[0] not in INLINE or x[1] != x[0]]
                found.append(Block("/".join(x[1] for x in shown), tuple(x[2] for x in shown), text, linked))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links, holders, hidden
        while len(stack) > depth:
            if any(x[0] not in INLINE or x[1] != x[0] for x in stack[depth:]):
                flush()
            name, shown, _ = stack.pop()
            hidden -= shown == name + HIDDEN
            links -= name == "a"
            holders -= name in HOLDERS

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at and not hidden:
            text = html.unescape(page[at:upto])
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                pop_to(depth)
            elif name not in INLINE:
                flush()
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not attributes.endswith("/"):
                at = close.end() if close else end
        elif name in VOID:
            if name not in INLINE:
                flush()
        else:
            if name not in INLINE:
                flush()
                if name in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            pop_to(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
                same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name)
                if same:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in same:
                            pop_to(i)
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "div"):
                            break
            element = len(tags)
            tags[element] = name
            kind = _outside(name, attributes, holders > 0)
            if kind and name in INLINE:
                flush()
            hidden += kind == HIDDEN
            stack.append((name, name + kind, element))
            links += name == "a"
            holders += name in HOLDERS
    pop_to(1)
    flush()
    return found, tags


def path_ratios(found: list[Block]) -> dict[str, tuple[float, float]]:
    """Text outside links per node and punctuation marks per node of every path."""
    length: dict[str, int] = defaultdict(int)
    marks: dict[str, int] = defaultdict(int)
    nodes: dict[str, int] = defaultdict(int)
    for b in found:
        length[b.path] += max(0, len(b.text) - b.linked)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        nodes[b.path] += 1
    return {p: (length[p] / n, marks[p] / n) for p, n in nodes.items()}


def path_scores(found: list[Block], measured: bool = True, named: bool = True) -> dict[str, float]:
    """Score of every path: fused ratios, smoothed among siblings, times what the names say.

    Without ``measured`` all ratios count as 1, without ``named`` all names do: for tests of what each decides.
    """
    ratios = path_ratios(found)
    fused = [ratios[b.path][0] * (1 + ratios[b.path][1]) if measured else 1.0 for b in found]
    total: dict[str, float] = defaultdict(float)
    nodes: dict[str, int] = defaultdict(int)
    for i, b in enumerate(found):
        # A Gaussian of radius 1; the place of a neighbour with another parent is taken by the block itself.
        near = [fused[j] if 0 <= j < len(found) and found[j].chain[:-1] == b.chain[:-1] else fused[i] for j in (i - 1, i + 1)]
        total[b.path] += 0.5 * fused[i] + 0.25 * sum(near)
        nodes[b.path] += 1
    return {p: total[p] / nodes[p] * (weight(p) if named else 1.0) for p in total}


def weight(path: str) -> float:
    return MARKED if NAMED in path else HELD if HOLDERS & set(path.split("/")) else 1.0


def content_paths(found: list[Block], score: dict[str, float], share: float = 0.5, of_best: float = 0.2, least: float = LEAST) -> set[str]:
    """Paths whose score reaches ``share`` of the scores' standard deviation over the blocks and ``of_best`` of the best."""
    mean = sum(score[b.path] for b in found) / len(found)
    spread = sqrt(sum((score[b.path] - mean) ** 2 for b in found) / len(found))
    limit = max(share * spread, of_best * max(score.values()), least)
    return {p for p, x in score.items() if x >= limit}


def main_blocks(page: str, measured: bool = True, named: bool = True) -> list[str]:
    found, tags = blocks(page)
    score = path_scores(found, measured, named)
    chosen = content_paths(found, score, least=LEAST if measured else 0.0) if found else set()
    picked = [i for i, b in enumerate(found) if b.path in chosen]
    if not picked:
        return []
    common = found[picked[0]].chain[:-1] or (0,)
    for i in picked:
        chain = found[i].chain[:-1] or (0,)
        common = common[: next((k for k, (x, y) in enumerate(zip(common, chain, strict=False)) if x != y), min(len(common), len(chain)))]
    first, last = picked[0], picked[-1]
    enough = OF_FILLED * max(score.values())

    def filled(i: int, b: Block) -> bool:
        """A short block between paragraphs, a heading right above the first one, or one not that much below the best."""
        heading = tags[b.chain[-1]] in HEADINGS
        between = first < i < last or heading and first - 2 <= i < first or score[b.path] >= enough
        return between and common[-1] in b.chain and not (named and NAMED in b.path) and b.linked <= 0.5 * len(b.text) and tags[b.chain[-1]] in FILLED

    return [b.text for i, b in enumerate(found) if b.path in chosen or filled(i, b)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = [main_blocks(page or "") for page in part.column(2).to_pylist()]
            texts = ["\n".join(x) for x in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, rows), pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks: one row for each page."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, SCHEMA)
