"""Tag-path ratios against a plain version, and pages on which they decide the text."""

import os
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from witloom.llm import html_extract as H

LONG = "A paragraph of the article, with some marks; it goes on for a while, as articles do, and then it ends."
ALSO = "Another one follows, written in much the same way, with commas, semicolons; and a full stop at its end."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Read more about the topic number {i}</a>" for i in range(6)) + "</ul>"

# Page, its text, and whether names alone (ratios off) give the same.
PAGES = [
    # A link box inside the article, by links alone.
    (f"<article><h1>Title</h1><p>{LONG}</p><p>{ALSO}</p><div>{LINKS}</div></article>", f"Title\n{LONG}\n{ALSO}", False),
    # Remarks below the paragraphs, in elements without a name.
    (f"<article><h1>Title</h1><p>{LONG}</p><p>{ALSO}</p><section><div><span>Nice!</span></div><div><span>Agreed</span></div><div><span>Me too</span></div></section></article>", f"Title\n{LONG}\n{ALSO}", False),
    # No article or main, no class: menu, text and foot told by ratios.
    (f"<body><div>{LINKS}</div><div><h2>Head</h2><p>{LONG}</p><ul><li>one point</ul><p>{ALSO}</p></div><div>All rights reserved</div></body>", f"Head\n{LONG}\none point\n{ALSO}", False),
    # A foot inside the main element without a name.
    (f"<main><p>{LONG}</p><p>{ALSO}</p><div>Share</div><div>Print</div></main>", f"{LONG}\n{ALSO}", False),
    # Marked boilerplate longer than the article.
    (f"<div class=ad>{LONG} {ALSO}</div><article><h1>Short</h1><p>Tiny text.</p></article><div id=comments><p>{LONG}</p></div>", "Short\nTiny text.", True),
    # Nothing but boilerplate.
    (f"<nav>{LINKS}</nav><footer>Some words, at the end of the page.</footer>", "", False),
    ("<article class=comment><p>A remark, of a reader.</p></article><article><p>The text, of the page.</p></article>", "The text, of the page.", True),
]


@pytest.mark.parametrize("page, text, by_names", PAGES)
def test_ratios_decide(page, text, by_names):
    assert "\n".join(H.main_blocks(page)) == text
    assert ("\n".join(H.main_blocks(page, measured=False)) == text) == by_names


class Plain(HTMLParser):
    """Text, marks and nodes by path of a well-formed page whose text stands in leaf elements."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [""], defaultdict(lambda: [0, 0, 0])

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        path = "/".join(t for t in self.open if t != "a")
        words = " ".join(data.split())
        if words:
            seen = self.found[path]
            seen[0] += 0 if "a" in self.open else len(words)
            seen[1] += sum(words.count(m) for m in ".,;:!?")
            seen[2] += 1


def test_ratios_match_a_plain_count():
    page = f"<body><div><ul><li><a>one, link</a></li><li>two. three!</li></ul></div><section><p>{LONG}</p><p>  {ALSO}\n</p><div><p>x; y</p></div></section><p>last?</p></body>"
    plain = Plain()
    plain.feed(page)
    found, _ = H.blocks(page)
    assert H.path_ratios(found) == {p: (n / k, m / k) for p, (n, m, k) in plain.found.items()}


SCORED = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(SCORED), reason="needs the tables")
def test_scores_change_given_pages(spark):
    pages = [r["html"] for r in spark.read.parquet(SCORED).select("html").collect()]
    whole = [H.main_blocks(p) for p in pages]
    off = sum(H.main_blocks(p, measured=False, named=False) != w for p, w in zip(pages, whole, strict=True))
    ratios_alone = sum(H.main_blocks(p, named=False) == w for p, w in zip(pages, whole, strict=True))
    assert off == len(pages) and ratios_alone > 0.3 * len(pages)


def test_long_and_clashing(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, 5, "c"), (1, "u", page, 6, None), (None, None, None, None, None)], "page_id long, url string, html string, n_chars long, path string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in H.extract(pages).collect())
    assert got == [(0, 0)] + [(1, 20_000 * (len(LONG) + 1) - 1)] * 2
