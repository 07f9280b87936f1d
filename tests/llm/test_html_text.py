import html
import itertools
import math
import random
import re

import pytest

from tessera.llm import html_text
from tessera.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


#: Names that no training page has.
HELD_CONTENT = ("hauptinhalt", "artikel", "beitrag", "texte", "primary", "lecture")
HELD_OTHER = {
    "menu": ("leiste", "auswahl"),
    "header": ("kopf", "oben"),
    "footer": ("fuss", "unten", "impressum"),
    "sidebar": ("rand", "neben"),
    "notice": ("hinweis", "meldung"),
    "advert": ("werbung", "anzeige"),
    "comments": ("kommentare", "meinungen"),
    "share": ("teilen", "schlagworte"),
}


def measured(model, pages):
    """Recall and precision in characters of blocks."""
    kept = wanted = both = 0
    for page in pages:
        nodes = html_text.parse(page)
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            if node.label is not None and node.text and node.tag not in html_text.HIDDEN | html_text.FORM:
                size = sum(len(t) for _, t in node.text)
                kept, wanted, both = kept + size * (p >= 0.5), wanted + size * node.label, both + size * (p >= 0.5) * node.label
    return both / wanted, both / kept


def test_held_out(model):
    """On other pages of the layouts that it was trained on, and on pages of which no name is known."""
    recall, precision = measured(model, labelled_pages(200, 99))
    assert recall > 0.95 and precision > 0.97, (recall, precision)
    recall, precision = measured(model, labelled_pages(200, 98, content_names=HELD_CONTENT, other_names=HELD_OTHER))
    assert recall > 0.93 and precision > 0.93, (recall, precision)


def test_given_pages(spark, model):
    """Pages of the given table, whose main text is what their one article element holds, by a plainer way."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)>", inside)
        flat = [" ".join(html.unescape(re.sub(r"</?(?:b|i|a)\b[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert html_text.main_text(r.html, model) == " ".join(b for b in flat if b), r.page_id


def test_marginals_are_exact(model):
    """Against the sum over all states of small trees."""
    r = random.Random(4)
    for _ in range(20):
        nodes = [html_text.Node("html", "", None, None)]
        for _ in range(r.randint(1, 7)):
            parent = r.choice(nodes)
            node = html_text.Node(r.choice(["p", "div", "nav", "article", "li"]), r.choice(["", "ad", "content"]), parent, None)
            parent.children.append(node)
            nodes.append(node)
        index = {id(x): k for k, x in enumerate(nodes)}
        scores = [model.score(x) for x in nodes]
        total, ones = 0.0, [0.0] * len(nodes)
        for states in itertools.product((0, 1), repeat=len(nodes)):
            weight = 1.0
            for k, x in enumerate(nodes):
                p = 1 / (1 + math.exp(-scores[k]))
                weight *= p if states[k] else 1 - p
                if x.parent is not None:
                    weight *= model.edge(x)[states[index[id(x.parent)]]][states[k]]
            total += weight
            for k, s in enumerate(states):
                ones[k] += weight * s
        assert model.marginals(nodes) == pytest.approx([o / total for o in ones])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>The  head &amp; tail</h1><p><b>First
 line<br>second &lt;b&gt; &copy; 3 &#65;<p>Next <a href="/x">linked</a> words, a &lt 4 and more text in a long enough paragraph.</p><div class="comments"><p>Nice one, thanks for it.</p></div></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other</a></li></ul></aside><form><p>Your mail</p><button>Send</button></form><footer>&copy; All rights</footer></body></html>"""
TEXT = "The head & tail First line second <b> © 3 A Next linked words, a < 4 and more text in a long enough paragraph."


def test_page(model):
    assert html_text.main_text(PAGE, model) == TEXT


LONG = "A paragraph of the article with a fair number of words in it, and a second clause. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><p>Plain paragraph of some words, and no more than that.</p></body>", "Plain paragraph of some words, and no more than that."),
        (f"<body><my-para>{LONG}</my-para><my-para>{LONG}</my-para></body>", (LONG * 2).strip()),
        (f"<p class=it's>{LONG}</p><p>{LONG}</p>", (LONG * 2).strip()),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><p style='color:red; Display: none'>{LONG}</p><div aria-hidden=true><p>{LONG}</p></div></article>", LONG.strip()),
        (f"<article><p>one <span style='display:none'>two <b>three</b></span>four {LONG}</p></article>", f"one four {LONG}".strip()),
        (f'<div class="post"><h1>Title of it</h1><p>{LONG}</p><div class="comment-body"><p>{LONG}</p></div></div>', f"Title of it {LONG}".strip()),
        (f'<article><p>{LONG}</p><div id="comment-12" class="comment-content"><p>I think so too, {LONG}</p></div></article>', LONG.strip()),
        (f'<article><p title="a > b" data-x=\'<p>\'>{LONG}</p></article>', LONG.strip()),
        (f"<article><p>{LONG}</p ><!--><p>{LONG}</p></article>", (LONG * 2).strip()),
        (f'<div class="css-9x8"><div class="m_77">{LONG}</div><div class="m_77">{LONG}</div></div>', (LONG * 2).strip()),
    ],
)
def test_forms_of_pages(model, page, text):
    assert html_text.main_text(page, model) == text


@pytest.mark.parametrize("cut", [40, 200, 500, 640, 700])
def test_truncated_pages(model, cut):
    got = html_text.main_text(PAGE[:cut], model)
    assert isinstance(got, str) and "Home" not in got and "Buy" not in got


@pytest.mark.parametrize("page", [None, "", " ", "<", "<>", "</p>", "a < b", "<p", "<!--", "<a href='", "<div>" * 3000, "</div>" * 3000, "<div>" * 20_000 + "</p><td>" * 20_000, "<p>" + "x " * 200_000, "<ul><li>a<li>b<table><tr><td>c<td>d<tr><td>e</table></ul>"])
def test_broken_pages(model, page):
    assert isinstance(html_text.main_text(page, model), str)


def test_table(spark, model):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 6), (None, None, None, None), (2, "v", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extracted(pages, model).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extracted(pages.limit(0), model).count() == 0
