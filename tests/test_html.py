import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidewarden import config as C
from tidewarden.functions import html as H, text as T


class Reader(HTMLParser):
    """Text of a page by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in H.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not set(self.open) & set(C.HIDDEN_TAGS):
            self.out.append(data)


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(reader.out).split())


PAGES = [
    "<div><header>a<header>b</header>c</header>d</div>e",
    "<div>a<header>b<p>c</div>d",
    "a<footer>b",
    "a</footer>b<header/>c<NoScript>d<br>e</noscript >f",
    "<section><header><div>x</div></section>y</header>z",
    """<a title="x > y" href='a>b'>link</a><a title=it's>quote</a> <p a = "1>2">z""",
    "&#38;lt; &amp;amp; &lt;b&gt; &copy2024 &notit; &notin; &nosuch; &NotEqualTilde; &eacute;&Eacute &# &; & &#x1F600;",
    "&#0;a&#128;b&#x9f;c&#55296;d&#1114112;e&#1;f&#99999999999999999999;g&#x0000000000000041;",
    "<script>if (a<b) '</p>'</script>x<style>p>q{}</style>y<script src=a>z</SCRIPT>w",
    "1 < 2 <b>3</b> <!-- <header> -->4<!doctype html>5<?php x ?>6", "", "<header></header>", "plain",
]


@pytest.mark.parametrize("page", PAGES)
def test_pages_equal_a_dom_reader(one, page):
    assert one(T.html_text, page) == read(page)


def test_random_trees_equal_a_dom_reader(spark):
    rnd = random.Random(5)
    parts = ["<div>", "</div>", "<p>", "</p>", "<header>", "</header>", "<footer class='>'>", "</footer>", "<noscript>",
             "</noscript>", "<br>", "<img alt=\"a>b\"/>", "w{} ", "w{} ", "w{}&amp;", "<script>h{}</script>"]
    pages = ["".join(rnd.choice(parts).replace("{}", str(k)) for k in range(rnd.randint(1, 30))) for _ in range(300)]
    got = spark.createDataFrame([(p,) for p in pages], "p string").select("p", T.html_text(F.col("p")).alias("t")).collect()
    for row in got:
        assert row.t == read(row.p), row.p


def test_every_named_reference(spark):
    names = sorted(html.entities.html5)
    df = spark.createDataFrame([(f"&{n}",) for n in names] + [(f"x&{n}=1y",) for n in names], "r string")
    for row in df.select("r", H.unescape(df.r).alias("t")).collect():
        assert row.t == html.unescape(row.r), row.r


def test_given_pages_equal_a_dom_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    rows = pages.select("html", T.html_text(F.col("html")).alias("t")).collect()
    assert rows
    for row in rows:
        assert row.t == (None if row.html is None else read(row.html))


def test_long_values_and_many_tags(one):
    page = "<p title='" + "x" * 200_000 + "'>a</p>" + "<p>b" * 3000 + "<header>" + "c" * 100_000
    assert one(T.html_text, page) == "a" + " b" * 3000
