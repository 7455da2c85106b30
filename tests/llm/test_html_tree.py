import itertools
import math

import pytest

from samplewright.llm import html_tree as H
from samplewright.llm.labelled_pages import labelled_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>no</p>";</script></head><body>
<header class="top"><p>Site name here. Welcome to it.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-bar"><p>We value your privacy. Accept all cookies now.</p></div><div class="ad">Buy our lamps today.</div>
<article><h1>Title &amp; more</h1><p>One   line,<br>
and <b>bold</b>.<p>Unclosed &lt;second&gt; &eacute;&#233; one.<aside class="ad-box"><p>Buy more now.</p></aside><form><p>Sign up now.</p></form>
<ul><li>First<li>Second</ul></article><section class="comments"><h3>Comments</h3><p>Great article, I loved it.</p></section>
<footer><p>Copyright text. All rights.</p></footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE, H.default_model()).split("\n") == [
        "Title & more", "One line, and bold.", "Unclosed <second> éé one.", "First", "Second",
    ]


def test_marginals_are_exact():
    """Message passing against the sum over all states of a small tree."""
    model = H.default_model()
    nodes = H.parse("<body><div class='ad'><p>x</p></div><article><p>Some text.</p><a href=x>l</a></article></body>")
    scores = [[0.0] * 2 for _ in nodes]
    for i, node in enumerate(nodes):
        for name in H.features(node):
            for s in (0, 1):
                scores[i][s] += model.seen.get(name, (0, 0))[s]
    total, on = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = model.start[states[0]]
        for i, node in enumerate(nodes):
            w += scores[i][states[i]]
            if i:
                w += model.child[H.kind_of(node)][states[node.parent]][states[i]]
        total += math.exp(w)
        for i, s in enumerate(states):
            on[i] += s * math.exp(w)
    assert model.marginals(nodes) == pytest.approx([x / total for x in on])


def test_held_out_labelled_pages():
    pages = labelled_pages()
    model = H.fit([p for i, p in enumerate(pages) if i % 3])
    right = wrong = 0
    for page in pages[::3]:
        nodes, states = H.parse(page), []
        for node in nodes:
            states.append((states[node.parent] if node.parent >= 0 else False) if node.label is None else node.label == "content")
        for node, state, p in zip(nodes, states, model.marginals(nodes), strict=True):
            if node.text:
                right, wrong = right + ((p > 0.5) == state), wrong + ((p > 0.5) != state)
    assert right / (right + wrong) > 0.97


ODD = [None, "", "<", "plain text only", "<p", "<p>a<p>b</div></div>", "<!-- open", "<script>never closed <p>x</p>", "&bogus; &#xFFFFFFFF; &amp",
       "<div>" * 5000 + "deep" + "</div>" * 3000, "</p>" * 20000, "<a href='x>y", "\x00<b>", "<article><p>" + "long " * 100_000 + "</p></article>"]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(i, None if i % 2 else "u", h, "t") for i, h in enumerate(ODD)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_text(pages, "page_id", "url", "html").collect()}
    assert len(got) == len(ODD) and got[0].text == "" and got[1].text == ""
    assert got[13].text == ("long " * 100_000).strip()
    assert got[7].text == ""


def test_empty(spark):
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html").count() == 0


@pytest.mark.parametrize(("inner", "text"), [
    ("The energy <math><mi>E</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></math> is constant here.", "The energy E=m2 is constant here."),
    ("With <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> as above.", "With x as above."),
    ("A chart <svg viewBox='0 0 1 1'><title>t</title><style>p{}</style><path d='M0'/><text>High</text><text>Low</text></svg> of it.", "A chart High Low of it."),
    ("An <img src='x'> icon and a l<wbr>ong word <svg/>here.", "An icon and a long word here."),
    ("See <object data='x'><param name='a'>the fallback</object> for it.", "See the fallback for it."),
    ("A film <video><source src='x'>can't be shown</video> here.", "A film can't be shown here."),
])
def test_embedded_parts_stay_in_their_block(inner, text):
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>One line of text.</p><p>{inner}</p><p>Another line.</p></article></body></html>"
    assert H.main_text(page, H.default_model()).split("\n") == ["Title", "One line of text.", text, "Another line."]


def test_parts_without_end(spark):
    assert H.main_text("<article><p>Some text. <math><annotation>never closed", H.default_model()) == "Some text."
    assert H.main_text("<article><p>Some text. <svg><desc>never closed <p>x", H.default_model()) == "Some text."
