"""Composite densities against a plain recursive version, and what they decide."""

import math
import random
import time
import xml.etree.ElementTree as ET

import pytest

from lodestone.llm import html_extract


def plain_counts(e):
    """Characters, tags, linked characters and link tags of an element, recursively."""
    chars, tags, linked, link_tags = len((e.text or "").replace(" ", "")), 0, 0, 0
    for x in e:
        c, t, lc, lt = plain_counts(x)
        chars += c + len((x.tail or "").replace(" ", ""))
        tags, linked, link_tags = tags + t + 1, linked + lc, link_tags + lt + (x.tag in ("a", "nav"))
    if e.tag in ("a", "nav"):
        linked = chars
    return chars, tags, linked, tags if e.tag == "nav" else link_tags


def plain_density(counts, body):
    c, t, lc, lt = counts
    if not c:
        return 0.0
    base = math.log(max(lc, 1) * c / max(c - lc, 1) + body[2] / max(body[0], 1) * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(base) if base > 1 else c / max(t, 1)


def tree(rng, depth):
    name = rng.choice(["div", "section", "nav", "ul", "blockquote"] if depth else ["p", "h2", "li"])
    if not depth:
        words = " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 30)))
        return f"<{name}>{words}{'<a>link text</a>' * rng.randint(0, 3)}<b>end</b></{name}>"
    return f"<{name}>{''.join(tree(rng, rng.randint(0, depth - 1)) for _ in range(rng.randint(1, 4)))}</{name}>"


@pytest.mark.parametrize("seed", range(40))
def test_densities_and_sums_are_those_of_the_formula(seed):
    rng = random.Random(seed)
    page = "<body>" + "".join(tree(rng, 3) for _ in range(3)) + "</body>"
    root = html_extract.parse(page)
    nodes = [n for n in html_extract.measure(root) if n.name != "html"]
    want = list(ET.fromstring(page).iter())
    assert [n.name for n in nodes] == [e.tag for e in want]
    outer = {id(x): e for e in want for x in e}

    def in_nav(e):
        while e is not None:
            if e.tag == "nav":
                return True
            e = outer.get(id(e))
        return False

    body = plain_counts(want[0])
    for n, e in zip(nodes, want, strict=True):
        if not in_nav(e):
            assert math.isclose(n.density, plain_density(plain_counts(e), body), abs_tol=1e-9)
        else:
            assert n.density == 0
    free = [(n, e) for n, e in zip(nodes, want, strict=True) if not in_nav(e)]
    sums = [sum(plain_density(plain_counts(x), body) for x in e if x.tag not in ("a", "b", "nav")) for n, e in free]
    assert math.isclose(max(n.total for n in nodes), max(sums), abs_tol=1e-9)


def site(article):
    menu = "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(6))
    return f"<body><nav><ul>{menu}</ul></nav><div class=ad>Buy these few things now.</div>{article}<footer>&copy; some firm of great renown</footer></body>"


PARAGRAPHS = "<h1>A short title</h1>" + "".join(f"<p>{f'words{i} ' * 20}</p>" for i in range(4))


def test_densities_decide(monkeypatch):
    pages = [site(f"<article>{PARAGRAPHS}</article>")] * 100
    before = [html_extract.extract(p) for p in pages]
    assert all(t.startswith("A short title words0") and t.endswith("words3") for t in before)
    rng = random.Random(3)
    monkeypatch.setattr(html_extract, "_density", lambda *_: rng.random())
    assert sum(html_extract.extract(p) != t for p, t in zip(pages, before, strict=True)) > 60


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
@pytest.mark.parametrize("wrapper", ["", "<div class='site has-sidebar'>", "<div class='post share-enabled'>", "<section class=commentary>", "<div class='public-notice-text'>"])
def test_the_densest_part_is_the_text_whatever_it_is_called(tag, wrapper):
    text = html_extract.extract(site(f"{wrapper}<{tag}>{PARAGRAPHS}</{tag}>"))
    for i in range(4):
        assert text.count(f"words{i}") == 20
    assert "menu" not in text and "Buy" not in text and "renown" not in text


@pytest.mark.parametrize("tag", ["article", "div"])
def test_long_adverts_and_comments_go(tag):
    advert = f"<div class='advert'>{'<p>' + 'buy ' * 90 + '</p>'}</div>"
    comments = f"<section class='comments'>{'<p>' + 'disagree ' * 60 + '</p>'}</section>"
    text = html_extract.extract(site(f"{advert}<{tag}>{PARAGRAPHS}</{tag}>{comments}"))
    assert text.count("words3") == 20 and "buy" not in text and "disagree" not in text


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</span>" * 20_000, "<div>" * 20_000 + "x", "<li>" * 20_000, "<article>" * 20_000 + "<p class=ad>x", "<a><b>" * 10_000 + "x", "<ul><li>" * 10_000 + "x" + "</p>" * 10_000, "<td>" * 20_000 + "x"])
def test_time_grows_with_the_length(page):
    start = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - start < 4


def test_references_end_at_tags():
    assert html_extract.extract("<p>a &am<b>p;lt; b</b></p>") == "a &amp;lt; b"
    assert html_extract.extract("<p>&amp;lt; &#8364;</p>") == "&lt; €"


def test_closing_tags_as_in_browsers():
    root = html_extract.parse("<table><tr><td><p>a<table><tr><td>b<td>c</table>d<td>e</table><ul><li>x<ul><li>y</ul>z<li>w</ul>")
    shape = lambda n: n if isinstance(n, str) else [n.name, *map(shape, n.children)]
    assert shape(root) == ["html", ["table", ["tr", ["td", ["p", "a"], ["table", ["tr", ["td", "b"], ["td", "c"]]], "d"], ["td", "e"]]], ["ul", ["li", "x", ["ul", ["li", "y"]], "z"], ["li", "w"]]]
