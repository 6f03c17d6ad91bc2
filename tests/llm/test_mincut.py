from __future__ import annotations

import html
import itertools
import random
import re

import pytest

from driftwell.llm.common import table
from driftwell.llm.mincut import BOILERPLATE, PRIOR, blocks_of, cut, extract, fit, main_text, scores, ties, weights
from driftwell.llm.q_mincut import op11_html_extraction

PLAIN = weights({})
LONG = "This is a sentence of some length, as articles have them, with a full stop at its end."


def cost(labels, unary, edges):
    return sum(abs(u) for u, x in zip(unary, labels) if (u > 0) != x and u) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        unary = [rng.randrange(-6, 7) / 2 for _ in range(n)]
        edges = [(i - 1, i, rng.randrange(1, 5) / 2) for i in range(1, n)] + [(a, b, rng.randrange(1, 5) / 2) for a, b in [sorted(rng.sample(range(n), 2)) for _ in range(n // 2)]]
        every = {x: cost(x, unary, edges) for x in itertools.product([False, True], repeat=n)}
        least = min(every.values())
        got = tuple(cut(unary, edges))
        assert every[got] == least
        # of all cheapest ones the one that keeps most
        assert all(not x[i] or got[i] for x, c in every.items() if c == least for i in range(n))


def plain_text(page):
    """The article of a page of the test tables, by its known form."""
    inside = re.sub(r"</?b>", "", page[page.index("<article>") + 9 : page.index("</article>")])
    return " ".join(" ".join(html.unescape(p).split()) for p in re.split(r"<[^>]*>", inside) if p.strip())


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r for r in op11_html_extraction(spark, sf_dir).collect()}
    assert got.keys() == pages.keys()
    for k, r in got.items():
        assert (r.url, r.text, r.n_chars) == (pages[k].url, plain_text(pages[k].html), len(r.text))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just words", "just words"),
        (f"<p>{LONG}<p>Tom &amp; Jerry &lt;3 &copy &#233;&#x4e;", f"{LONG} Tom & Jerry <3 © éN"),
        (f"<body><p>{LONG}</p>a < b and 1<2<br/>next&nbsp;\n line</body>", f"{LONG} a < b and 1<2 next line"),
        (f"<script>if (a</p>b) {{'<p>no</p>'}}</script><style>p{{}}</style><title>no</title><p>{LONG}</p><!-- no <p>no</p> --><noscript>no</noscript>", LONG),
        (f"<article><p>{LONG}</p><p>Yes.</p><div class='ad'>{LONG} Buy.</div><ul><li>one</li><li>two</ul><p>Fo<b>o</b>t <a href='x'>link</a></p></article><p>{LONG} aside</p>", f"{LONG} Yes. one two Foot link"),
        (f"<div class='site-header'><h2>Site</h2></div><div id=menu><a href=1>A</a></div><div class='post-content'><h1>Head</h1><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div><footer>x</footer>", f"Head {LONG}"),
        (f"<form action=x><main><p>{LONG}</p></main></form><form><p>{LONG}</p><label>Name</label><select><option>a</select></form>", LONG),
        (f"<main><p>{LONG}</p><section class='no-sidebar'><p>In.</p></section><section class='sidebar'><p>{LONG}</p></section><div role=alert>{LONG}</div><p hidden>{LONG}</p><p style='display: none'>x</p></main>", f"{LONG} In."),
        (f"<nav><ul><li><a>x</a></ul></nav><p title=\"don't > stop\" data-x='a>b'>{LONG}</p><p title=don't>Then.</p>", f"{LONG} Then."),
        (f"<div><p>{LONG}</p><p>{LONG} Two.</p></div><ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(6)) + "</ul><p>© 2020 All rights reserved</p>", f"{LONG} {LONG} Two."),
        (f"<p>{LONG} <span class=ad>buy <span>it</span> now</span> after <span>that</span>s.</p>", f"{LONG} after thats."),
        (f"<p>{LONG}</p><p class='x", LONG),
        (f"<p>{LONG}</p><!-- never ends <p>x</p>", LONG),
        ("<html><head><title>t</title></head><body></body></html>", ""),
    ],
)
def test_pages(page, want):
    assert extract(page, PLAIN) == want


def test_smoothness_keeps_short_blocks_among_long_ones():
    page = f"<div><p>{LONG}</p><div>Fig</div><p>{LONG}</p></div>"
    blocks = blocks_of(page)
    alone = scores(blocks, PLAIN)
    assert alone[1] < 0 < alone[0]
    assert cut(alone, ties(blocks)) == [True] * 3 and cut(alone, []) == [True, False, True]


def test_long_and_deep_pages():
    assert extract("<div>" * 20_000 + LONG + "</div>" * 20_000, PLAIN) == LONG
    many = extract("<nav><a href=x>no</a></nav>" + f"<p>{LONG}</p><p>x</p>" * 20_000, PLAIN)
    assert many == " ".join([LONG, "x"] * 20_000)


def test_weights_are_learned_from_all_pages(spark):
    rows = [(i, "u", f"<article><p>{LONG}</p></article><nav><a href=x>{LONG}</a></nav>") for i in range(200)]
    model = fit(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert model["links:most"] == -2.0 < PLAIN["links:most"] and model["tag:p"] > PLAIN["tag:p"]
    assert fit(spark.createDataFrame([], "page_id long, url string, html string")) == PLAIN and PLAIN.keys() == PRIOR.keys()


def test_odd_rows(spark):
    rows = [(None, None, None, "a"), (1, "u", "", "b"), (1, "u", f"<p>{LONG}</p>", "c"), (1, "u", f"<p>{LONG}</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in main_text(pages, PLAIN).collect())
    assert got == [(0, "", ""), (1, "u", ""), (1, "u", LONG), (1, "u", LONG)]
    raw = spark.sql("SELECT 5L AS page_id, 'u' AS url, CAST(X'3C703E41FF3C2F703E' AS STRING) AS html")
    assert [r.text for r in main_text(raw, PLAIN).collect()] == ["A�"]
    assert main_text(pages.filter("false"), PLAIN).count() == 0


def test_elements_say_what_they_are():
    (block,) = blocks_of("<div class='articleBody'><div id='userComments'><p>x</p></div></div>")
    assert block.element.says == BOILERPLATE
