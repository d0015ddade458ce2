from __future__ import annotations

import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import html_extraction as H
from tests.llm.conftest import FOLDER

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="p{n}">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We store data</div>
<div class="post item-{n}"><h2>Title {n} &amp; more</h2><p>First   paragraph&nbsp;of page {n} with <a href="x">a link</a> in it.
<p>Second<br>paragraph &lt;here&gt; that is long enough.<ul><li>one<li>two</ul><form><p>Name</p></form>
<div class="ad">Buy things</div><section id="comments"><p>A reader wrote this comment here.</p></section></div>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def expected(n):
    return f"Title {n} & more\nFirst paragraph of page {n} with a link in it.\nSecond paragraph <here> that is long enough.\none\ntwo"


def extracted(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract(frame).collect()}


def test_the_article_without_what_surrounds_it(spark):
    rows = [(n, f"http://Host.example/{n}", PAGE.format(n=n)) for n in range(4)]
    assert extracted(spark, rows) == {n: expected(n) for n in range(4)}


def test_the_host_outvotes_a_single_page(spark):
    """A page whose longest container is not its article, on a host where others agree."""
    odd = "<body><div class='story'><p>Short but the real story of this page.</p></div><div class='wall'><p>{}</p></div></body>"
    rows = [(n, "https://news.example/a", f"<body><div class='story'><p>{'Story text. ' * 20}</p></div><div class='wall'><p>few words only here</p></div></body>") for n in range(5)]
    rows += [(9, "https://news.example:443/b", odd.format("Wall text. " * 30)), (10, None, odd.format("Wall text. " * 30))]
    found = extracted(spark, rows)
    assert found[9] == "Short but the real story of this page."
    assert found[10].startswith("Wall text.")


def test_every_path_of_a_host_counts(spark):
    """80 sections, each with its own path: the least voted one still decides for its pages."""
    def page(section, story, wall):
        return f"<body class='{section}'><div class='{section}'><p>{story}</p></div><div class='wall-{section}'><p>{wall}</p></div></body>"

    sections = ["s" + chr(97 + n // 26) + chr(97 + n % 26) for n in range(80)]
    rows = [(n, "http://h/", page(s, "Story text. " * 20, "few words only here")) for s in sections for n in range(3)]
    rows += [(100 + n, "http://h/", page(s, f"The short story of {s} itself.", "Wall text. " * 30)) for n, s in enumerate(sections)]
    found = extracted(spark, rows)
    assert [found[100 + n] for n in range(80)] == [f"The short story of {s} itself." for s in sections]


def test_paths_equal_those_of_brute_force(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").withColumn("host", H.host_of(F.col("url"))).collect()
    votes, scores = Counter(), []
    for row in pages:
        own = {path: score for path, score in H.Page(row.html or "").scores().items() if score > 0}
        scores.append(own)
        for path, score in own.items():
            votes[row.host, path] += round(score / max(own.values()), 6)
    frame = spark.createDataFrame([(i, r.url, r.html) for i, r in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract(frame).collect()}
    for i, (row, own) in enumerate(zip(pages, scores)):
        best = min(own, key=lambda path: (-round(votes[row.host, path], 6), path)) if own and row.host else None
        assert found[i] == H.Page(row.html or "").text(best)


def test_broken_and_empty_pages(spark):
    deep = "<div>" * 3000 + "<p>Deep inside there is one paragraph.</p>"
    rows = [(1, "http://a/", None), (2, "http://a/", ""), (3, "http://a/", "<nav>only a menu</nav>"),
            (4, "x", "plain text, no markup"), (5, None, "<p>unclosed <b>bold"), (6, "http://b/", deep)]
    assert extracted(spark, rows) == {
        1: "", 2: "", 3: "", 4: "plain text, no markup", 5: "unclosed bold", 6: "Deep inside there is one paragraph.",
    }


def test_the_driver_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for row in H.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        texts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in blocks]
        assert row.text == "\n".join(t for t in texts if t)


@pytest.mark.parametrize("url, host", [("http://U:p@A.b:80/x?y#z", "a.b"), ("a.b/x", ""), ("ftp://h", "h"), ("", "")])
def test_hosts(spark, url, host):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(H.host_of(F.col("url"))).first()[0] == host


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    row = (1, "http://h/", PAGE.format(n=1))
    frame = spark.createDataFrame([row, row], "page_id long, url string, html string")
    names = {name: F.lit(name) for name in ("host", "html_key", "path", "votes")}
    found = H.extract(frame.withColumns(names))
    assert found.columns == [*frame.columns, *names, "text"]
    assert [r.text for r in found.collect()] == [expected(1)] * 2
    assert H.extract(frame.where("false")).collect() == []
