"""Main text of pages: what may not be lost, and templates of generated sites by brute force."""

import random
from collections import defaultdict

import pytest

from panelforge.llm import pages

SCHEMA = "page_id bigint, url string, html string"


def text(html):
    return [t for t, _, _ in pages.blocks(html)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main></main><div><p>the whole body</p></div>", ["the whole body"]),
        ("<main><h1>T</h1></main><div><p>body one</p><p>body two</p></div>", ["T", "body one", "body two"]),
        ("<main><h1>T</h1><p>in main</p></main><div>beside</div>", ["T", "in main"]),
        ("<article><h1>T</h1><p>a</p><section class='legal'><h2>Law</h2><p>said there</p></section></article>", ["T", "a", "Law", "said there"]),
        ("<article><h1>T</h1><p>a</p><div class='newsletter'>buy</div></article><div>side note</div>", ["T", "a"]),
        ("<h1>T</h1><div><p>body</p></div><article><h2>Other</h2><p>teaser</p></article>", ["T", "body", "Other", "teaser"]),
        ("<div class='cookie-banner'>ok?</div><div><p>body</p></div><div id='site-footer'>imprint</div><div class='post-comments'><p>first!</p></div>", ["body"]),
        ("<div class='has-sidebar no-comments'><p>body</p></div>", ["body"]),
        ("<div class='page-header'><h1>T</h1></div><p>body</p>", ["T", "body"]),
        ("<section class='legal'>imprint</section><p>body</p>", ["body"]),
        ("<main>", []),
        (None, []),
    ],
)
def test_no_main_text_is_lost(html, want):
    assert text(html) == want


def sites():
    """Pages of generated sites with their blocks: (host, blocks); a block is (html, text, template)."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passed_on = words(8)
    out = []
    for h in range(4):
        outside, inside = words(5), words(6)
        for k in range(14 if h < 3 else 6):
            blocks = [(f"<div>{outside}</div>", outside, h < 3), (f"<article><h1>{passed_on if k % 2 else words(3)}</h1>", None, False)]
            own = [f"<p>{(x := words(9))}</p>" for _ in range(3)]
            blocks += [(b, b[3:-4], False) for b in own]
            blocks.append((f"<p>{inside}</p>", inside, h < 3))
            if k % 3:
                blocks.append((f"<p>{passed_on}</p>", passed_on, False))
            out.append((f"h{h}.org", blocks))
    return out


def test_templates_of_generated_sites(spark):
    told = sites()
    rows = [(i, f"https://{host}/{i}", "<html><body>" + "".join(b[0] for b in blocks) + "</article></body></html>") for i, (host, blocks) in enumerate(told)]
    got = {r.page_id: r for r in pages.extract_main_text(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as uid", "3 as own", "4 as text")).collect()}
    for i, (_, blocks) in enumerate(told):
        head = blocks[1][0].removeprefix("<article><h1>").removesuffix("</h1>")
        want = [head] + [t for _, t, gone in blocks[2:] if not gone]
        assert got[i].text.split("\n") == want and got[i].n_chars == len(got[i].text)
    counts = defaultdict(int)
    for host, _ in told:
        counts[host] += 1
    assert counts["h3.org"] == 6  # too few pages to tell a template


def test_long_and_empty_pages(spark):
    rows = [(1, "http://a/1", "<article><h1>T</h1>" + "<p>word &amp; word</p>" * 30_000), (2, None, None), (3, "http://a/3", ""), (None, "x", "<p>a</p>")]
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].count("\n") == 30_000 and got[2] == got[3] == "" and got[None] == "a"
    assert pages.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
