"""Counters and verdicts of sites, macros and source maps of files: cases that the pages don't have."""

from pagemill.operators import extract, report


def test_macros_of_files(spark):
    files = [
        (1, "a.js", "f({a}); g(\"{x} {x}\", '{offer}', `{y}${z} \\` {w}`)"), (2, "b.CSS", "p{a:url('{x}')} q{b:url({offer})} r{c:url({offer}{x})} s{d:{e}}"),
        (3, "c.mjs", None), (4, "d.json", '"{x}"'), (5, None, '"{x}"'), (6, "e.css", ""),
    ]
    rows = extract.file_macros(spark.createDataFrame(files, "kind_id int, rel_path string, content string")).collect()
    assert sorted((r.kind_id, r.kind, r.token) for r in rows) == [(1, "own", "{offer}"), (1, "script", "{x} {y} {w}"), (2, "image", "{x}"), (2, "own", "{offer}"), (2, "own", "{offer}")]


def test_source_maps(spark):
    files = [("a.js.map", "{}"), ("b.js", "x //# sourceMappingURL=b"), ("c.txt", "//# sourceMappingURL=b"), ("d.css", None), (None, "x")]
    rows = extract.unmapped(spark.createDataFrame(files, "rel_path string, content string")).collect()
    assert [(r.outcome, r.content) for r in rows] == [("deleted", None), ("stripped", "x "), ("kept", files[2][1]), ("kept", None), ("kept", "x")]


def test_site_stats(spark):
    pages = [("s", "<script>fetch('https://e.test/')</script><img src=https://e.test/a.gif>{x}{offer}{x}"), ("s", None), (None, "<? echo 1 ?><a href=b>c</a>")]
    rows = {r.site_id: {k: v for k, v in r.asDict().items() if v and k != "site_id"} for r in report.site_stats(spark.createDataFrame(pages, "site_id string, html string")).collect()}
    assert rows["s"].pop("script_warnings") >= 1
    assert rows["s"] == {"pages": 2, "inline_scripts": 1, "suspicious_scripts": 1, "own_macros": 1, "foreign_macros": 2, "img_quarantine": 1}
    assert rows[None] == {"pages": 1, "server_pages": 1, "anchor_keep": 1}
    assert report.site_stats(spark.createDataFrame([], "site_id string, html string")).count() == 0


def test_site_verdicts(spark):
    runs = [("a", "p", "desktop", True, 0, None, False), ("a", "p", "mobile", True, None, 25.0, None), ("b", "p", "mobile", None, 2, 25.04, False), ("b", "q", "mobile", True, 1, 30.0, True), (None, "p", "desktop", True, 0, 3.0, False)]
    requests = [("a", "https://cdn.jsdelivr.net/npm/x"), ("a", "/own.css"), ("b", "https://e.test/"), ("b", "https://e.test/2"), ("b", "//f.test/"), (None, None), ("c", "https://e.test/")]
    runs = spark.createDataFrame(runs, "site_id string, page string, profile string, loaded boolean, n_errors int, difference double, has_quiz boolean")
    told = {r.site_id: (r.ok, r.verdict) for r in report.site_verdicts(runs, spark.createDataFrame(requests, "site_id string, url string")).collect()}
    assert told == {
        "a": (True, "no requests to foreign hosts; pages: 1, profiles: desktop+mobile; looks different by up to 25.0%"),
        "b": (False, "pages did NOT load, nothing is proven; 2 FOREIGN hosts asked; pages: 2, profiles: mobile; 3 errors of scripts; looks different by up to 30.0%, look at the layout; has a quiz, click through it by hand"),
        None: (True, "no requests to foreign hosts; pages: 1, profiles: desktop; looks different by up to 3.0%"),
    }


def test_categories(spark):
    rows = spark.createDataFrame([("a/B.JPG", "xhr"), ("x", "other"), (None, None), ("c.mjs", "websocket"), ("d.html?x", "")], "path string, kind string")
    found = rows.select(extract.file_category(rows.path), extract.request_category(rows.kind)).collect()
    assert [tuple(r) for r in found] == [("image", "data"), ("other", "other"), ("other", "other"), ("js", "websocket"), ("html", "other")]
