"""Cleaning, scripts, streams and files on small inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.operators import extract, html, markup, scripts
from pagemill.plans import catalog
from pagemill.sources import files
from pagemill.streaming import pages as streaming

PAGE = """<html><head><base href="/x"><meta name="google-site-verification" content="1"><link rel="stylesheet" href="https://evil.test/a.css">
<script src="https://code.jquery.com/jquery-3.6.1.min.js"></script><script>var s = "</p><img src='https://evil.test/q.png'>"; gtag('js')</script></head>
<body onload="init()"><a href="https://shop.test/buy" class=x>b</a><a href='javascript:x()'>j</a><a href="#top">t</a><object><img src="https://evil.test/i.png"></object>
<p onclick="fetch('https://evil.test')">é<img src="/own.png"></p><img src="https://evil.test/p.gif"></body></html>"""


def test_elements_know_their_place():
    for e in markup.elements_of(PAGE):
        if e["tag"] == "#text":
            assert e["body"] == PAGE[e["start"] : e["stop"]] and "<" not in e["body"]
            continue
        assert PAGE[e["start"]] == "<" and PAGE[e["stop"] - 1] == ">"
    raw = [e for e in markup.elements_of(PAGE) if e["tag"] == "script"]
    assert len(raw) == 2 and "</p>" in raw[1]["body"]


def test_cleaned_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "plain <b>text"), (4, "<?php x ?>a")], "page_id long, html string")
    got = {r.page_id: r.html for r in html.cleaned(df).collect()}
    text = got[1]
    assert "evil.test" not in text and "gtag" not in text and "<base" not in text and "javascript:" not in text
    assert 'href="{offer}" class=x' in text and 'href="#top"' in text and "jquery-3.6.1" in text and '<img src="/own.png">' in text and 'onload="init()"' in text
    assert got[2] == "" and got[3] == "plain <b>text" and got[4] == "a"
    again = html.cleaned(spark.createDataFrame([(1, text)], "page_id long, html string")).first()
    assert again.html == text


def test_policy_goes_behind_head(spark):
    df = spark.createDataFrame([(1, "<head><title>a</title></head>")], "page_id long, html string")
    assert html.cleaned(df, "<meta x$1>").first().html == "<head><meta x$1><title>a</title></head>"


def test_noscript_goes_by_its_addresses(spark):
    inside = [
        '<iframe src="https://www.googletagmanager.com/ns.html?id=GTM-X" height="0"></iframe>', "<IMG alt='a>b' SRC='//unlisted.test/p'>", "<script src=https://unlisted.test/a.js></script>",
        '<img src="/own.png">', '<img src="data:image/gif;base64,AA" data-src="https://unlisted.test">', "please turn on scripts https://unlisted.test", '<img src="/own.png"><img src="https://unlisted.test/p">',
    ]
    df = spark.createDataFrame([(i, f"<p>a<noscript>{x}</noscript>b</p>") for i, x in enumerate(inside)], "page_id long, html string")
    got = {r.page_id: r.html for r in html.cleaned(df).collect()}
    assert {i for i, text in got.items() if "noscript" not in text} == {0, 1, 2}
    assert got[6] == '<p>a<noscript><img src="/own.png"></noscript>b</p>'


def test_styles_lose_external_addresses(spark):
    page = """<style>@import url(//evil.test/a.css);p{color:red}</style><p style='background:url(https://evil.test/x.png);font:"A&amp;B"' id=x>é</p><p style="color:red">"""
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    r = html.cleaned(df).first()
    assert "evil.test" not in r.html and r.n_edits == 2 and "p{color:red}</style>" in r.html
    assert "font:&quot;A&amp;B&quot;" in r.html and r.html.endswith(' id=x>é</p><p style="color:red">')


def test_threats(spark):
    code = ["fetch('https://evil' + '.test/a')", "fetch('/own')", "new Image().src = 'https://own.test/x'", "eval(atob('eA=='))", "location.href='//evil.test'", "document.addEventListener('keydown', e => fetch('/k'))", None]
    df = spark.createDataFrame([(i, c, "own.test") for i, c in enumerate(code)], "page_id int, body string, main_host string")
    assert {(r.page_id, r.threat) for r in scripts.threats(df).collect()} == {(0, "fetch"), (3, "obfuscated eval"), (4, "redirect"), (5, "keylogger")}


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(i, "https://a.test", PAGE) for i in range(20)], streaming.PAGES)
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    streaming.classify_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), extract.classified(pages)
    assert got.count() == want.count() and not got.exceptAll(want.select(got.columns)).count()


def test_site_files(spark, tmp_path):
    for name in ("s1/index.html", "s1/a b/x.JS", "s2/_quarantine/001.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    got = {(r.site_id, r.rel_path, r.ext, r.size) for r in files.site_files(spark, str(tmp_path)).collect()}
    assert got == {("s1", "index.html", "html", 1), ("s1", "a b/x.JS", "js", 1)}
    rows = spark.createDataFrame([("f", "T", "d", None, None)], "file string, type string, description string, snippet string, line int")
    files.write_changelog(rows, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["f | T | d | - | -"]


def test_css_and_svg(spark):
    row = spark.createDataFrame([("@import url(//evil.test/a.css); a{background:url('//evil.test/x$1.png')}b{background:url(i.png)}", '<svg onload="x()"><script>1</script><a xlink:href="https://evil.test">t</a><foreignObject>q</foreignObject></svg>')], "css string, svg string")
    r = row.select(extract.clean_css(F.col("css")).alias("c"), extract.svg_cleaned(F.col("svg")).alias("s")).first()
    assert r.c.strip() == "a{background:url('')}b{background:url(i.png)}" and r.s == "<svg><a>t</a></svg>"


def test_nested_noscripts_and_long_numbers_are_read(spark):
    evil = "<img src=https://evil.test/a.png>"
    pages = ["<noscript>" * 3000 + evil, evil + "<i title='&#" + "9" * 5000 + ";'>x</i>", evil + "<i title=&#" + "0" * 5000 + "65;>x</i>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {r.page_id: r.html for r in html.cleaned(df).collect()}
    assert len(got) == 3 and not any("evil.test" in x for x in got.values())
    assert html.error_log(html.cleaned_or_error(df)).count() == 0
    assert [markup.unescaped("&#" + x) for x in ("0" * 5000 + "65;", "9" * 5000 + ";", "0" * 5000, "65;66")] == ["A", "\ufffd", "\ufffd", "A66"]


def test_a_page_that_cannot_be_read_ends_the_job(spark, monkeypatch):
    def fails(text, *more, **named):
        if "bad" in text:
            raise ValueError("can't be read")
        return []

    monkeypatch.setattr(markup, "elements_of", fails)
    df = spark.createDataFrame([(1, "good"), (2, "bad <img src=https://evil.test/a.png>")], "page_id long, html string")
    for clean in (html.cleaned, html.planned, html.held):
        with pytest.raises(Exception, match="can't be read"):
            clean(df).collect()
    assert [tuple(r) for r in html.error_log(html.cleaned_or_error(df)).collect()] == [(2, "markup", "ValueError", "can't be read")]


def test_cleaned_images_of_odd_pages_equal_sql(spark, tmp_path):
    evil, own = '<img src="https://evil.test/a.png">', '<img src="/own.png">'
    pages = [(None, evil + own), (None, own), (7, evil + "<i title='&#" + "9" * 5000 + ";'>x</i>" + own), (8, None), (8, evil)]
    spark.createDataFrame([(i, "https://own.test/", p) for i, p in pages], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(catalog.ORACLE_SQL["cleaned_images"])
    got = catalog.cleaned_images(spark, str(tmp_path)).select(want.columns).collect()
    assert len(got) == 3 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
