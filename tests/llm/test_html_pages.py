"""Extraction over whole tables of pages against a plain reading of their articles, and pages without article or main."""

import html
import re
import time

import pytest

from pathwarden.llm import html_text, queries


def plain(page):
    """The blocks of a page's only article, by patterns."""
    a = re.search(r"<article>(.*)</article>", page or "<article></article>", re.S).group(1)
    a = re.sub(r"<br[^>]*>", " ", re.sub(r"<!--.*?-->", "", a, flags=re.S))
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|table|tr|td|section)\b[^>]*>", a)
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
    return "\n".join(x for x in out if x)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_every_row_of_pages(spark, scale):
    sf = f"/root/testdata/{scale}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize("tag", ["div", "section"])
def test_density_finds_the_same_without_article(spark, tag):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"(</?)article>", rf"\1{tag}>", r["html"])
        assert html_text.extract(bare) == plain(r["html"])


def naive(root):
    """Composite density by its formulas, counted anew for every node, and the node that it selects."""
    ws = html_text._WS

    def text(n, links):
        return sum(0 if links and n.tag != "a" else len(ws.sub(" ", c).strip()) for c in n.children if isinstance(c, str)) + sum(text(c, False) if n.tag == "a" or not links or c.tag == "a" else text(c, links) for c in n.children if not isinstance(c, str) and not c.out)

    def below(n):
        for c in n.children:
            if not isinstance(c, str) and not c.out:
                yield c
                yield from below(c)

    def density(n):
        import math

        chars, tags = text(n, False), list(below(n))
        if not chars:
            return 0.0
        links = chars if n.tag == "a" else text(n, True)
        whole, linked = text(root, False), text(root, True)
        anchors = sum(c.tag == "a" for c in tags)
        base = math.log(chars / max(1, chars - links) * (links or 1) + linked / whole * chars + math.e)
        return chars / (len(tags) or 1) * math.log(max(chars / (links or 1) * (len(tags) or 1) / (anchors or 1), 1 + 1e-9)) / base

    nodes = [n for n in [root, *below(root)] if n.tag != "html" and text(n, False)]
    body = next(n for n in [root, *below(root)] if n.tag == "body")
    of = {id(n): density(n) for n in nodes}
    total = lambda n: sum(of.get(id(c), 0.0) for c in n.children if not isinstance(c, str) and not c.out)
    top = max(nodes, key=lambda n: of[id(n)])
    path, n = [of[id(body)]], top
    while n is not None and n is not body:
        path.append(of[id(n)])
        n = n.parent
    return max((n for n in nodes if of[id(n)] >= min(path) and total(n) > 0), key=total, default=body)


SECTIONS = [
    ("<div><p>" + "short note. " * 3 + "</p></div><div>" + "".join(f"<p>{'long text of the story goes on here. ' * k}</p>" for k in (9, 4, 12)) + "</div>", 1),
    ("<section>" + "".join(f"<p>{'words and words in a row. ' * 14}</p>" for _ in range(5)) + "</section><section>" + "".join(f"<p><a href=x>{'link text here '}</a> end</p>" for _ in range(9)) + "</section>", 0),
    ("<div><ul>" + "<li><a href=x>one link</a></li>" * 12 + "</ul></div><div><div>" + "".join(f"<p>{'the article has <b>marks</b> and a <a href=y>link</a> inside. ' * 6}</p>" for _ in range(4)) + "</div></div>", 1),
]


@pytest.mark.parametrize("inner, at", SECTIONS)
def test_sections_compete_by_their_sums(inner, at):
    root = html_text.parse(f"<html><body>{inner}</body></html>")
    best = html_text.select(root)
    assert best is naive(root)
    body = next(c for c in root.children if not isinstance(c, str) and c.tag == "body")
    sections = [c for c in body.children if not isinstance(c, str)]
    n = best
    while n is not None and n is not sections[at]:
        n = n.parent
    assert n is sections[at]


def test_open_noscripts_take_time_by_their_number():
    def took(n):
        page = "<article><p>text " + "<noscript>" * n
        began = time.perf_counter()
        html_text.extract(page)
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 30 * took(1000) + 0.5
    assert html_text.extract("<article><p>a<noscript><p>hidden</p></noscript><p>b<noscript>c</article>").split("\n")[:2] == ["a", "b"]


def test_odd_pages(spark):
    rows = [(1, None, None, 9), (1, "u", "", 9), (None, "u", "<p>same</p>", 9), (None, "u", "<p>same</p>", 9), (2, "u", "<article>" + "<p>x &amp; y</p>" * 30_000, 9)]
    got = html_text.op4_html(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(((r["page_id"] or 0), len(r["text"]), r["n_chars"]) for r in got) == [(0, 4, 4), (0, 4, 4), (1, 0, 0), (1, 0, 0), (2, 6 * 30_000 - 1, 6 * 30_000 - 1)]
    assert html_text.op4_html(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
