import math
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from spanwise.llm import extraction as ex

LONG = "A fairly long paragraph about one matter, with several words in it, so that it has some weight. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies. {LONG}</div>
<div class="ad">Buy this. {LONG}</div><article><header><h1>Heading &amp; more</h1></header><p>First   para<br>graph. {LONG}<p><b>Second</b> &#233;&nbsp;one
here. {LONG}</p><form><label>Mail</label><input></form><ul><li>point one<li>point two</ul></article>
<section id="comments"><h2>Comments</h2><p>Great! {LONG}</p><p>So true. {LONG}</p></section><aside>Also {LONG}</aside><footer>&copy; {LONG}</footer></body></html>"""


def test_article_only():
    flat = " ".join(LONG.split())
    assert ex.main_text(PAGE).split("\n\n") == ["Heading & more", f"First para graph. {flat}", f"Second é one here. {flat}", "point one", "point two"]


@pytest.mark.parametrize("page,text", [("", ""), ("plain words", "plain words"), ("<p>open", "open"), ("<div hidden>x</div>", ""), ("<p>1 &lt; 2 &amp", "1 < 2 &"), ("<nav>menu only</nav>", ""), ("<script>never closed", ""), ("<!-- never closed", ""), ("a < b", "a < b")])
def test_small_pages(page, text):
    assert ex.main_text(page) == text


def test_density_without_an_article_element():
    body = f"<div id=top><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id=main><p>{LONG}</p><p>{LONG}{LONG}</p><p>short.</p></div><div id=links>" + "".join(f"<p><a href={k}>link number {k}</a></p>" for k in range(9)) + "</div>"
    text = ex.main_text(f"<html><body>{body}</body></html>")
    assert text.count("\n\n") == 2 and text.endswith("short.") and "link" not in text and "three" not in text


def test_headings_and_short_sections_beside_the_densest():
    flat = " ".join(LONG.split())
    page = f'<body><div class=page><div class=post><h1>Title</h1><div class=text><p>{LONG}</p><p>{LONG}</p></div></div><div><a href=1>{LONG}</a></div></div></body>'
    assert ex.main_text(page) == f"Title\n\n{flat}\n\n{flat}"
    assert ex.main_text(f"<table><tr><td><a href=1>menu</a><td><p>{LONG}</p></table>") == flat
    assert ex.main_text(f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</td><td>d</td></tr></table></article>") == f"{flat}\n\na b\n\nc d"


def test_forgotten_end_tag_and_deep_nesting():
    assert ex.main_text(f"<nav><a href=x>x</a><article><p>{LONG}</p></article>") == " ".join(LONG.split())
    assert ex.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


FLAT = " ".join(LONG.split())


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "entry long-form", "header-fixed content"])
@pytest.mark.parametrize("inner", ["<p>{}</p>", "<article><p>{}</p></article>"])
def test_words_in_the_class_of_the_whole_page(name, inner):
    assert ex.main_text(f'<body><div class="{name}">{inner.format(LONG)}</div><div class="sidebar">Short.</div></body>') == FLAT


def test_comments_longer_than_the_article():
    assert ex.main_text(f'<body><article><p>{LONG}</p></article><div class="comments"><p>{LONG * 3}</p></div></body>') == FLAT


def test_form_round_the_whole_page():
    assert ex.main_text(f"<body><form><div><p>{LONG}</p></div></form></body>") == FLAT
    assert ex.main_text(f"<body><form><label>Mail</label></form><div><p>{LONG}</p></div></body>") == FLAT


@pytest.mark.parametrize("page", [
    f'<div><p class="ad">Buy<p>{LONG}</div>', f'<ul><li class="social">Share<li>{LONG}</ul>', f'<table><tr><td class="side">Menu<td><p>{LONG}</p></table>',
    f'<div><div><span class="ad">Buy</div><p>{LONG}</p></div>', f"<div><div><nav>Menu</div><p>{LONG}</p></div>",
])
def test_cut_elements_without_end_tag(page):
    assert ex.main_text(page) == FLAT


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", None), (3, "w", "<p>" + "word " * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"], len(r["text"]), r["n_chars"]) for r in ex.extract(pages).collect()), key=repr)
    n = len(ex.main_text(PAGE))
    assert got == sorted([(1, "u", n, n), (1, "u", n, n), (2, None, 0, 0), (0, "v", 0, 0), (3, "w", 499_999, 499_999)], key=repr)
    assert ex.extract(pages.limit(0)).collect() == []


class Tree(HTMLParser):
    """An independent, slow reading of well-formed pages: [tag, weight, texts and children in order]."""

    def __init__(self, page):
        super().__init__()
        self.top = ["html", 1.0, []]
        self.open = [self.top]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = [tag, 0.05 if any(k == "class" and v in ("ad", "comments") for k, v in attrs) else 1.0, []]
        self.open[-1][2].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counted(node, linked=False):
    """Characters, characters in links, tags and link tags within a node, by descending; each descendant times the weights between."""
    chars = links = tags = link_tags = 0
    for x in node[2]:
        if isinstance(x, str):
            n = len(x) if x.strip() else 0
            chars, links = chars + n, links + n * linked
        else:
            c, l, t, k = counted(x, linked or x[0] == "a")
            w = x[1]
            chars, links, tags, link_tags = chars + w * c, links + w * l, tags + w * (t + 1), link_tags + w * (k + (x[0] == "a"))
    return chars, links, tags, link_tags


def brute_scores(top):
    """(tag, density, sum of the children's densities) of each block element in document order, from the formulas."""
    all_chars, all_links, _, _ = counted(top)
    ratio, out = all_links / max(all_chars, 1), []

    def visit(node, weight):
        c, lc, t, lt = counted(node)
        t, lt = max(t, 1), max(lt, 1)
        base = max(math.log(c / max(c - lc, 1) * lc + ratio * c + math.e), 1)
        density = weight * c / t * math.log(max((c / max(lc, 1)) * (t / lt), 1)) / base if c else 0.0
        entry = [node[0], density, density]
        out.append(entry)
        inner = [visit(x, weight * x[1]) for x in node[2] if not isinstance(x, str) and x[0] in ex.BLOCK]
        if inner:
            entry[2] = sum(inner)
        return density

    visit(top, 1.0)
    return out


def random_page(rng, depth=0):
    kinds = ["div", "section", "p", "a", "b", "text", "text", "br"]
    made = []
    for _ in range(int(rng.integers(1, 6))):
        kind = kinds[rng.integers(0, 8 if depth < 5 else 1)] if depth < 5 else "text"
        words = " ".join("x" * int(n) for n in rng.integers(1, 12, rng.integers(1, 25)))
        if kind in ("text", "br"):
            made.append(words + "<br>" * (kind == "br"))
        elif kind in ("a", "b"):
            made.append(f"<{kind}>{words}</{kind}>")
        elif kind == "p":
            made.append(f"<p>{words}</p>")
        else:
            name = ("", ' class="ad"', ' class="comments"', ' class="x"')[rng.integers(0, 4)]
            made.append(f"<{kind}{name}>{random_page(rng, depth + 1)}</{kind}>")
    return "".join(made)


@pytest.mark.parametrize("seed", range(40))
def test_every_nodes_density_against_the_formulas(seed):
    page = random_page(np.random.default_rng(seed))
    got = [(n.tag, n.density, n.total) for n in ex.score(ex.parse(page))]
    want = brute_scores(Tree(page).top)
    assert [x[0] for x in got] == [x[0] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[1:] == pytest.approx(tuple(b[1:]), rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def real_pages(sf_dir):
    return [x or "" for x in pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").column("html").to_pylist()]


def test_density_decides(real_pages, monkeypatch):
    whole = [ex.main_text(x) for x in real_pages]
    for page, text in zip(real_pages, whole, strict=True):  # here each article is one element
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        assert text == ex.main_text(f"<article>{inner}</article>") and len(text) > 0
    real = ex.mark

    def everything(root):
        real(root)
        for node in ex.ordered(root):
            node.marked = True
        return 0.0

    monkeypatch.setattr(ex, "mark", everything)
    without = [ex.main_text(x) for x in real_pages]
    assert sum(a != b for a, b in zip(whole, without, strict=True)) > 0.9 * len(whole)


def test_names_of_classes_only_weigh(real_pages, monkeypatch):
    whole = [ex.main_text(x) for x in real_pages]
    weight = ex.weight_of
    monkeypatch.setattr(ex, "weight_of", lambda *a: 1.0 if weight(*a) == ex.LIGHT else weight(*a))
    without = [ex.main_text(x) for x in real_pages]
    assert sum(a == b for a, b in zip(whole, without, strict=True)) > 0.9 * len(whole)


@pytest.mark.parametrize("name", ["related", "alert", "share", "side"])
def test_content_under_a_misleading_name(name):
    assert ex.main_text(f'<body><div class="{name}"><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div>Short.</div></body>') == f"Title\n\n{FLAT}\n\n{FLAT}"


def test_sections_of_an_article():
    parts = "".join(f"<section><h2>Part {k}</h2><p>{LONG}</p><p>{LONG}</p></section>" for k in range(3))
    page = f'<body><div class="ad">Buy now, it is cheap.</div><article><h1>All</h1>{parts}</article><div><a href=1>one</a> <a href=2>two</a></div></body>'
    assert ex.main_text(page) == "All\n\n" + "\n\n".join(f"Part {k}\n\n{FLAT}\n\n{FLAT}" for k in range(3))
