"""Truth tables of the URL functions."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls

CASES = [
    ("", "script", "keep", None),
    (None, "img", "keep", None),
    ("js/app.js", "script", "keep", None),
    ("//code.jquery.com/jquery.js", "script", "keep", "code.jquery.com"),
    ("https://code.jquery.com.evil.test/jquery.js", "script", "quarantine", "code.jquery.com.evil.test"),
    (" https://evil.test/a", "script", "quarantine", "evil.test"),
    ("ht\ttps://evil.test/a", "script", "quarantine", "evil.test"),
    ("//ev\nil.test/a", "img", "quarantine", "evil.test"),
    ("https://user@www.hotjar.com:443/x", "script", "remove", "www.hotjar.com"),
    ("https://x.test/js/fbevents.js", "script", "remove", "x.test"),
    ("https://assets.example.com/a.png", "img", "keep", "assets.example.com"),
    ("https://assets.example.com/a.js", "script", "quarantine", "assets.example.com"),
    ("data:image/png;base64,AA", "img", "keep", None),
    ("data:text/html,x", "iframe", "quarantine", None),
    ("JavaScript:x()", "anchor", "remove", None),
    ("java\nscript:x()", "anchor", "remove", None),
    ("blob:https://a/b", "media", "keep", None),
    ("https://cdn.jsdelivr.net/gh/a/b/c.js", "script", "quarantine", "cdn.jsdelivr.net"),
    ("https://cdn.jsdelivr.net/npm/@popperjs/core@2/x.js", "script", "keep", "cdn.jsdelivr.net"),
    ("https://unpkg.com/unknown@1/x.js", "script", "quarantine", "unpkg.com"),
    ("https://unpkg.com/unknown@1/x.png", "img", "keep", "unpkg.com"),
    ("https://evil.test/{offer}", "anchor", "quarantine", "evil.test"),
    ("https:///x", "script", "quarantine", None),
    ("mailto:a@b.c", "anchor", "keep", None),
]


def test_verdicts(spark):
    rows = [(i, u, k) for i, (u, k, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, url string, kind string")
    got = {r.i: (r.action, r.host) for r in urls.with_verdict(df, "url", "kind").collect()}
    alone = {r.i: (r.v.action, r.v.host) for r in df.select("i", urls.verdict(F.col("url"), F.col("kind")).alias("v")).collect()}
    assert got == alone == {i: (a, h) for i, (_, _, a, h) in enumerate(CASES)}


@pytest.mark.parametrize("url,path,name", [("https://a.test/x/Y.js?v=1#z", "/x/Y.js", "y.js"), ("//a.test", "", "a.test"), ("x/y?z", "x/y", "y"), ("https://a.test?q=/b", "", "a.test")])
def test_parts(spark, url, path, name):
    u = F.lit(url)
    r = spark.range(1).select(urls.path(u).alias("p"), urls.basename(u).alias("b")).first()
    assert (r.p, r.b) == (path, name)
