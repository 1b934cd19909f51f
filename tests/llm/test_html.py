import random
import re
import time
import tracemalloc
from html.parser import HTMLParser

import pytest

from brindle.llm.html_text import extract, page_texts
from brindle.session import read_table

CASES = {
    "<p>One<p>Two": "One\n\nTwo",
    "a<br>b<br/>c": "a\nb\nc",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "<b>bold</b>ly  go\n ing": "boldly go ing",
    "<h1>T</h1>text<h2>U</h2>": "T\n\ntext\n\nU",
    "<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>": "- a\n- b\n  - c\n  - d\n- e",
    "<ol start=9><li>a<li>b<p>c</ol>": "9. a\n10. b\n\n    c",
    "<li>alone": "- alone",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n  d\n  e",
    "<blockquote><p>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<table><tr><th>Name<th>N<tr><td>Al<td>12<tr><td>Barbara<td>3</table>": "Name     N\nAl       12\nBarbara  3",
    "<table><td>a<td>b</table>": "a  b",
    "<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>": "wide one  x\na  b      c",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r  1\n   2",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table>stray<tr><td>a</table>": "stray\na",
    "<table><tr><td><table><tr><td>in</table><td>out</table>after": "in  out\n\nafter",
    "<pre>\n a\n  b </pre>c": " a\n  b\n\nc",
    "x<pre>a  b</pre>": "x\n\na  b",
    "a<!-- <p>no --><!doctype html>b": "ab",
    "a<script>'</p>'</script>b<style>p{}</style>": "ab",
    "<title>T</title><body>b": "b",
    "<p hidden>no</p><p style='color:red;display : none'>no</p><p style='visibility:hidden'>no</p>yes": "yes",
    "<template><p>no</template><noscript>no</noscript>yes": "yes",
    "<textarea>a\n b</textarea>": "a\n b",
    "<select><option>a<option>b</select>": "a\nb",
    "<input type=submit value=Go><input type=hidden value=no><input value=no>": "Go",
    "&lt;p&gt; &amp; &eacute; &nbsp;x &unknown;": "<p> & é  x &unknown;",
    "1 < 2 and 3<4 <5>": "1 < 2 and 3<4 <5>",
    "</p>a</div></b>b": "ab",
    "<p>a</br>b": "a\nb",
    "<a href=\"x>y\" title='>'>t</a>": "t",
    "<a href=\"never closed>t</a> u": "t u",
    "<p><b>x<p>y</b>z": "x\n\nyz",
    "": "",
    " \n ": "",
    "plain": "plain",
    "<script>never closed <p>x": "",
    "a<br><br>b": "a\n\nb",
    "<head><title>T</title><p>Hello world": "Hello world",
    "<head><meta charset=x><link rel=y> \n<script>no</script>Hello": "Hello",
    "<head><title>T</title></head>a<head>b": "ab",
    "a<script src=http://x/>document.write('</div>');alert(1)</script>b<script/>no</script>": "ab",
    "<svg><title/><style/>x</svg>b<svg><title>no</title><g>d<p>c": "xbd\n\nc",
    "<svg><path d=a/><p>a<script>no('</p>')</script>": "a",
    "<svg><foreignObject><script/>no</script><p>a</foreignObject><style/>b</svg>c": "a\n\nbc",
    "a<dialog>no</dialog><dialog open>b</dialog>c": "a\nb\nc",
    "<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</p>": "yes",
    "<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>": "- yes",
    "<table><tr><td rowspan=0>r<td>1<tr><td>2<tbody><tr><td>3<td>4</table>": "r  1\n   2\n3  4",
    "<table><tr><td rowspan=9>r<td rowspan=2>s<td>1<tr><td>2<tr><td>3<td>4</table>": "r  s  1\n      2\n   3  4",
}


@pytest.mark.parametrize("source", list(CASES))
def test_layout(source):
    assert extract(source)[1] == CASES[source]


def test_title_and_counts():
    assert extract("<title> A &amp;\n b</title><ul><li>x<li hidden>y</ul><table><tr><td>z</table>") == ("A & b", "- x\n\nz", 1, 1)
    assert extract(None) == ("", "", 0, 0)


class Plain(HTMLParser):
    """All text outside of what is never shown."""

    def __init__(self):
        super().__init__()
        self.skip, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "head", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "head", "template")

    def handle_data(self, data):
        if not self.skip:
            self.found.append(data)


def test_no_visible_text_is_lost(spark, small):
    squeeze = lambda s: re.sub(r"\s", "", s)
    pages = read_table(spark, small, "pages").select("page_id", "html").collect()
    got = {r["page_id"]: r for r in page_texts(read_table(spark, small, "pages")).collect()}
    assert len(got) == len(pages)
    for p in pages:
        plain = Plain()
        plain.feed(p["html"])
        text = re.sub(r"(?m)^ *(- |\d+\. )", "", got[p["page_id"]]["text"])
        assert squeeze(text) == squeeze("".join(plain.found))


def test_time_is_linear():
    for source in ('<a "' * 50000, "<" * 200000, "<div>" * 50000 + "x", "<p" * 50000, "<table><tr><td>" * 3000 + "x", "<li>" * 50000, "<!--" * 50000, "</x" * 50000, "&" * 100000):
        extract(source)


@pytest.mark.parametrize("before", ["<div>" * 200, "<b>" * 5000, "<a name=x>" * 200, "<div><span>" * 30000])
def test_no_depth_is_too_much(before):
    for source, text in {
        "a<script>var no;</script><style>p{}</style>b": "ab",
        "a<template><p>no</template><noscript><b>no</b></noscript>b": "ab",
        "a<span hidden>no<i>no</i></span><div style='display:none'>no<div>no</div>no</div>b": "ab",
        "<div hidden><div><p>no</div>no</div>yes": "yes",
        "<ul><li>a<li>b<ol><li>c</ol></ul>": "- a\n- b\n  1. c",
        "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
        "<pre>a  b</pre>": "a  b",
    }.items():
        assert extract(before + source)[1] == text
    assert extract(before + "<ul><li>a<li hidden>b</ul><table><tr><td>c</table>")[2:] == (1, 1)
    assert extract("<ul><li>" * 300 + "x<p>y") == ("", "- " * 300 + "x\n\n" + "  " * 300 + "y", 300, 0)


def test_cells_stand_in_columns_at_any_width():
    for wide in (60, 61, 200, 3000):
        long, words = "w" * wide, "x " * (wide // 2)
        lines = extract(f"<table><tr><td>a<td>b<td>c<tr><td>{long}<td>{words}<td>d</table>")[1].split("\n")
        assert lines[0].index("b") == wide + 2 == lines[1].index("x")
        assert lines[0].index("c") == lines[1].index("d")


def test_padding_is_bounded():
    wide = "w" * 5000
    text = extract("<table>" + f"<tr><td>{wide}<td>b" + "<tr><td>a<td>b" * 100 + "</table>")[1]
    assert len(text) < 5 * 5500 + 2000 and text.startswith(wide + "\n ")
    lines = text.split("\n")
    assert len({line.index("b") for line in lines[1:]}) == 1 and [x.split() for x in lines] == [[wide], ["b"], *[["a", "b"]] * 100]


def test_spans_cost_nothing():
    cell = "<td rowspan=1000 colspan=1000>x"
    for source in ("<table><tr>" + cell * 1000 + "<tr><td>y" * 1000 + "</table>", "<table>" + ("<tr>" + cell) * 1000 + "</table>"):
        tracemalloc.start()
        began = time.process_time()
        text = extract(source)[1]
        assert text.count("x") == 1000
        assert time.process_time() - began < 5 and tracemalloc.get_traced_memory()[1] < 100 << 20  # tracing takes most of it
        tracemalloc.stop()
        assert len(text) < 20_000


def test_second_extractor():
    """The order of visible words of random pages, against a walk over the page while it is made."""

    def page(rng, depth, hidden, invisible, words):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice("t t t b d h v s x l n c e".split()) if depth else "t"
            inner = lambda h=hidden, i=invisible: page(rng, depth - 1, h, i, words)  # noqa: E731, B023
            if kind == "t":
                word = f"w{rng.randrange(10**6)}"
                if not hidden and not invisible:
                    words.append(word)
                out.append(f" {word} ")
            elif kind in "bd":
                tag = rng.choice(["b", "i", "span", "a href=x/"] if kind == "b" else ["div", "p", "section", "blockquote", "h2"])
                out.append(f"<{tag}>" + (inner() if tag != "p" else f"<em>{page(rng, 0, hidden, invisible, words)}</em>") + f"</{tag.split()[0]}>")
            elif kind == "h":
                out.append(rng.choice(["<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<template>{}</template>", "<dialog>{}</dialog>"]).format(inner(True)))
            elif kind == "v":
                out.append(f"<div style='color:red; visibility: hidden'>{inner(i=True)}</div>")
            elif kind == "s":
                out.append(f"<div style='visibility:visible'>{inner(i=False)}</div>")
            elif kind == "x":
                out.append(rng.choice(["<script src=http://x/>no(\"</div>\")</script>", "<style>no{}</style>", "<!-- no -->", "<svg><title>no</title><path d='m'/></svg>", "<dialog hidden open>no</dialog>"]))
            elif kind == "l":
                out.append("<ul>" + "".join(f"<li>{inner()}" for _ in range(2)) + "</ul>")
            elif kind == "n":
                out.append(f"<dialog open>{inner()}</dialog>")
            elif kind == "c":
                out.append("<table>" + "".join(f"<tr><td colspan={rng.randint(0, 3)}>{page(rng, 0, hidden, invisible, words)}" for _ in range(3)) + "</table>")
            else:
                out.append("<svg/><br/>")
        return "".join(out)

    for seed in range(300):
        rng, words = random.Random(seed), []
        body = page(rng, 4, False, False, words)
        head = rng.choice(["", "<head><title>T</title>", "<head><title>T</title><script>no</script></head><body>", "<body>"])
        assert re.findall(r"w\d+|no", extract(head + body)[1]) == words, seed


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "<p>a", "x"), (2, "<p>a", "x"), (None, "b", "x"), (3, "<p>long " * 20000, "x")]
    got = page_texts(spark.createDataFrame(rows, "page_id bigint, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"][:5], r["n_chars"] > 10) for r in got) == [(0, "b", False), (1, "", False), (2, "", False), (2, "a", False), (2, "a", False), (3, "long\n", True)]
    assert page_texts(spark.createDataFrame([], "page_id bigint, html string")).collect() == []
