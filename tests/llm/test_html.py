"""HTML rendering against a plain renderer of random trees, known pages, odd pages, and pages made to be slow."""

import random
import time

import pytest

from tessera.llm import html_text
from tessera.llm.html_text import render


def test_known_pages():
    page = "<p>a<b>b</b> c<p>d<ul><li>x<li>y<ol><li>1<li>2</ol></ul><table><tr><td>aa<td>b<tr><th>c<th>dddd</table>t<div hidden>no</div><script>x<p></script><pre>q  w\n e</pre>z &amp; <br>k<a href='x>y'>l</a> 3 < 4 <a hre"
    assert render(page)[0] == "ab c\n\nd\n\n- x\n- y\n  1. 1\n  2. 2\n\naa  b\nc   dddd\n\nt\n\nq  w\n e\n\nz &\nkl 3 < 4"
    for odd, text in ((None, ""), ("", ""), ("</p>", ""), ("<td>x", "x"), ("<!--", ""), ("<script>", ""), ("plain", "plain"), ("<p>x</3 y>z", "xz"), ("a <!-> b", "a b"), ("<!-->c", "c"), ("x<?php y ?>z", "xz"), ("a</", "a"), ("a < b", "a < b"), ("<div>" * 5000 + "deep", "deep")):
        assert render(odd)[0] == text, odd


def test_attributes_end_where_they_should():
    assert render("<p title=it's>hello don't stop</p><p title=\"5\" tall\">x</p>")[0] == "hello don't stop\n\nx"
    assert render("<a href=\"x>y\" title='<p>'>k</a><input type=submit value='Go &amp; stop'><input type=hidden value=no>")[0] == "k Go & stop"


def test_visibility():
    assert render('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div><p style="display: none">a</p><p>c')[0] == "b\n\nc"
    assert render("<dialog>no</dialog><dialog open>yes</dialog><select><option>o1<option>o2</select><map>m</map><textarea> a\n b</textarea>")[0] == "yes\no1\no2\nm\n a\n b"
    assert render("<head><title>t</title><p>shown")[0] == "shown" and render('<p style="display:block;DISPLAY: none !important">x')[0] == ""


def test_implied_tags_and_stray_end_tags():
    assert render("<b><p>x</b>y</p>z")[0] == render("<span><p>x</span>y</p>z")[0] == "xy\n\nz"
    assert render("<table><tr><td>a</div></p>b<td>c</table>")[0] == "a  c\nb"
    assert render("<ol start=5><li>a<p>para<li value=9>b<li>c</ol><dl><dt>t<dd>d</dl>")[0] == "5. a\n   para\n9. b\n10. c\n\nt\nd"


def test_tables():
    page = "<table><caption>cap</caption><tr><td>a<br>bb<td>c<tr><td colspan=2>long spanning text here<td>z<tr><td rowspan=2>r<td>s<td>t<tr><td>u<td><table><tr><td>in<td>ner<tr><td>2<td>3</table></table>"
    assert render(page)[0].split("\n") == ["cap", "a   c", "bb", "long spanning text here  z", "r   s                    t", "    u                    in  ner", "                         2   3"]
    wide = "x" * 500
    assert render(f"<table><tr><td>{wide}<td>a<tr><td>b<td>c</table>")[0] == f"{wide}  a\nb{' ' * 201}c"


class Node:
    def __init__(self, name, *children, hidden=False):
        self.name, self.children, self.hidden = name, children, hidden


def tree(rng, depth, inside=()):
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    if depth == 0 or rng.random() < 0.25:
        return " ".join(word() for _ in range(rng.randint(1, 4)))
    name = rng.choice(["div", "p", "b", "ul", "ol", "table", "span", "section"])
    if name == "p" and "p" in inside:
        name = "b"
    if ("p" in inside or "b" in inside) and name in ("div", "ul", "ol", "table", "section"):
        name = "span"
    hidden = rng.random() < 0.08
    sub = lambda n=name: tree(rng, depth - 1, (*inside, n))
    if name in ("ul", "ol"):
        return Node(name, *(Node("li", *(sub("li") for _ in range(rng.randint(1, 2)))) for _ in range(rng.randint(1, 3))), hidden=hidden)
    if name == "table":
        return Node(name, *(Node("tr", *(Node("td", sub("td")) for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 3))), hidden=hidden)
    return Node(name, *(sub() for _ in range(rng.randint(1, 4))), hidden=hidden)


def markup(node, rng):
    if isinstance(node, str):
        return node
    inner = "".join(markup(c, rng) for c in node.children)
    close = "" if node.name in ("li", "tr", "td") and rng.random() < 0.7 else f"</{node.name}>"
    return f"<{node.name}{' hidden' * node.hidden}>{inner}{close}"


def plain(children, tight, in_list):
    """Lines of a block context, by recursion over the tree."""
    lines, line = [], ""

    def flush():
        nonlocal line
        if line.strip():
            lines.append(line.strip())
        line = ""

    def gap():
        if not tight and lines and lines[-1]:
            lines.append("")

    def walk(node, in_list):
        nonlocal line
        if isinstance(node, str):
            line += node
            return
        if node.hidden:
            return
        if node.name in ("b", "span"):
            for c in node.children:
                walk(c, in_list)
            return
        flush()
        spaced = node.name in ("p", "ul", "ol", "table") and not in_list
        if spaced:
            gap()
        if node.name in ("ul", "ol"):
            for k, item in enumerate(node.children):
                mark = f"{k + 1}. " if node.name == "ol" else "- "
                inner = plain(item.children, True, True)
                lines.extend((mark if j == 0 else " " * len(mark)) + x if x else "" for j, x in enumerate(inner))
        elif node.name == "table":
            cells = [[plain(td.children, True, in_list) for td in tr.children] for tr in node.children]
            width = [max((len(x) for r in cells if c < len(r) for x in r[c]), default=0) for c in range(max(map(len, cells)))]
            shown = [c for c in range(len(width)) if width[c]]
            for r in cells:
                if len(cells) == 1 and len(r) == 1:
                    lines.extend(r[0])
                    continue
                for k in range(max(map(len, r))):
                    parts = [(r[c][k] if c < len(r) and k < len(r[c]) else "").ljust(width[c]) for c in shown]
                    lines.append("  ".join(parts).rstrip())
        else:
            for c in node.children:
                walk(c, in_list)
            flush()
        if spaced:
            gap()

    for c in children:
        walk(c, in_list)
    flush()
    out = [x for k, x in enumerate(lines) if x or k and lines[k - 1]]
    while out and not out[-1]:
        out.pop()
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_trees(seed, monkeypatch):
    monkeypatch.setattr(html_text, "WIDE", 10**6)
    monkeypatch.setattr(html_text, "LINE", 10**6)
    rng = random.Random(seed)
    for _ in range(25):
        children = [tree(rng, 4) for _ in range(rng.randint(1, 4))]
        page = "<body>" + "".join(markup(c, rng) for c in children)
        assert render(page)[0] == "\n".join(plain(children, False, False)), page


SLOW = [
    "<a " * 300_000 + '"', "<" * 1_000_000, "<td></tr>" * 100_000, "<table><tr><td><table>" + "<b>" * 150_000 + "<td></tr>" * 50_000, "<ul><li>x" * 50_000, "<table><tr><td>x" * 60_000, "<p>" * 300_000, "<!" * 500_000,
    "<table><tr>" + "<td colspan=1000>x" * 50_000, "<table><tr><td rowspan=60000 colspan=1000>a" * 2000 + "<tr><td>b" * 20_000, "<script>" * 100_000, "<x a=" + "\"'" * 300_000, "<dl><dt><div>" * 70_000, "<p title=" + "a" * 1_000_000 + ">x",
]


def test_pages_made_to_be_slow():
    for page in SLOW:
        start = time.process_time()
        render(page)
        assert time.process_time() - start < 8, page[:40]


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "<p>x", 0), (1, "<p>x", 0), (2, None, 0), (None, "", 0)], "page_id long, html string, visible_text int")
    assert sorted(r[1] for r in html_text.extract(pages).collect()) == ["", "", "x", "x"]
    assert html_text.extract(pages.where("false")).count() == 0
