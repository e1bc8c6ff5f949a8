"""The Markdown of pages: nested and unclosed blocks, and time linear in the page."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import html
from tarnwork.functions.markdown import DEPTH, markdown, pieces

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e": "- a\n  - b\n  - c\n- d\n\ne",
    "<ol><li>a<p>b</p></li><li>c</ol>": "1. a\n\n   b\n2. c",
    "<blockquote>a<blockquote>b</blockquote></blockquote>c": "> a\n>\n> > b\n\nc",
    "<blockquote><ul><li>a</li><li>b</ul>": "> - a\n> - b",
    "<pre>  x\n   y &lt;z&gt;\n\n</pre>t": "```\n  x\n   y <z>\n```\n\nt",
    "<pre>a ``` b</pre>": "````\na ``` b\n````",
    "<h1>a<br>b</h1>c<h3>d": "# a b\n\nc\n\n### d",
    "a<br>b<hr>c": "a\nb\n\n---\n\nc",
    "x<b> y </b>z<i></i><b>w": "x **y** z**w**",
    "<b>a<i>b</b>c</i>d": "**a*b***cd",
    "<div><p>a</div>b": "a\n\nb",
    "<div><nav>menu<ul><li>x</div>text": "text",
    "<script>a<b</script>c<style>p{": "c",
    "<head><title>T</title><p>x": "x",
    "before<body>in<footer>f</footer>": "in",
    "<table><tr><th>k<th>v<tr><td>1<td>a<p>b</table>": "| k | v |\n| --- | --- |\n| 1 | a b |",
    "<table><tr><td>one<tr><td>two</table>": "> one\n>\n> two",
    "<table><tr><td>a<table><tr><th>x<th>y<tr><td>1<td>2</table>z<td>b</table>end": "a\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\nz\n\nb\n\nend",
    "<table><caption>c</caption><tr><td>1<td>2<td>3": "c\n\n| 1 | 2 | 3 |\n| --- | --- | --- |",
    "a < b <3 &amp;lt; &eacute;<!-- no -->!": "a < b <3 &lt; é!",
    "<li>loose<li>items": "- loose\n- items",
    "</div></p></ul>a</td>": "a",
    "a<a href=x>b</a><img src=y>c<span>d</span>": "abcd",
    "": "",
    "<": "<",
    "a<b": "a<b",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert markdown(page) == CASES[page]


TAGS = ["<p>", "</p>", "<div>", "</div>", "<ul>", "</ul>", "<ol>", "<li>", "</li>", "<b>", "</b>", "<i>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<th>", "<nav>", "</nav>", "<pre>", "</pre>", "<blockquote>", "</blockquote>", "<h2>", "</h2>", "<br>", "<body>", "<head>", "<script>", "</script>", "<!--", "-->", "<hr>", "<code>", "<footer>", "</footer>", "word ", "x", " ", "\n", "&amp;", "<", ">"]


def test_no_markup_breaks_the_pass():
    r = random.Random(1)
    for _ in range(4000):
        assert isinstance(markdown("".join(r.choices(TAGS, k=r.randrange(60)))), str)


def test_words_outside_silent_elements_stay():
    r = random.Random(2)
    shown = [t for t in TAGS if not t.startswith(("<nav", "</nav", "<body", "<head", "<script", "</script", "<!--", "-->", "<footer", "</footer", "<", ">")) or t in ("<p>", "<div>", "</div>", "<ul>", "</ul>", "<li>", "<b>", "</b>", "<td>", "<tr>", "<table>", "</table>", "<blockquote>", "</blockquote>", "<h2>")]
    for n in range(1500):
        page = "".join(t + (f" w{i}x " if i % 3 == 0 else "") for i, t in enumerate(r.choices([t for t in shown if t not in ("<", ">")], k=40)))
        got = markdown(page)
        assert all(f"w{i}x" in got for i in range(0, 40, 3)), page


def test_a_megabyte_of_anything_is_linear():
    pages = [
        "<div>" * 200_000, "<p>x" * 200_000, "<b>" * 300_000, "<ul><li>" * 100_000, "<blockquote>a" * 60_000, "</div>" * 150_000, "<" * 1_000_000, "<!--" * 250_000,
        "<section><table><td>" + "<div>" * 90_000 + "</section>" * 60_000, "<table><tr><td>" * 60_000, "<script>" * 120_000, "<nav><div>" * 100_000, "<ul>" * 100_000 + "</div>" * 100_000,
        "<b>a<i>b</b>c" * 80_000, "<pre>" * 200_000, "&" * 1_000_000, "<table>" + "<td>x" * 150_000, "<a href='" + "x" * 1_000_000, "<ul>" + "<li>x" * 200_000,
    ]
    for page in pages:
        began = time.time()
        markdown(page)
        assert time.time() - began < 15, page[:20]
    assert markdown("<blockquote>" * 100 + "x") == "> " * DEPTH + "x"


def test_a_piece_is_a_text_with_the_known_tag_behind_it():
    page = "a<P x>b<span>c</span>d</p><!-- <p> --><script>if (a<b) </Script><3"
    assert list(pieces(page)) == [("a", "", "p"), ("b", "", None), ("c", "", None), ("d", "/", "p"), ("", "", "script"), ("", "/", "script"), ("<", "", None), ("3", "", None)]


def test_column(spark):
    rows = spark.createDataFrame([("<title>T</title><body><p>首页Home<p>原文<p>text",), (None,), ("",), ("<h1>T</h1>",)], "page string")
    got = [r["m"] for r in rows.select(html.html_markdown("page", F.lit("stem")).alias("m")).collect()]
    assert got == ["# T\n\ntext", None, "# stem\n\n", "# T"]
