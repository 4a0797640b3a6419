"""References between files of saved sites: paths, moves, repair, deleted files, fetching, libraries; on small sites whose results are known or can be had by brute force."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import paths
from pagemill.operators import html, sites
from pagemill.sources.tables import saved

FILES = "site_id string, rel_path string, content string"


def files(spark, rows):
    return spark.createDataFrame([("s", p, c) for p, c in rows.items()], FILES)


def contents(df):
    return {r.rel_path: r.content for r in df.collect()}


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("../x/./y.png?a=../b#f", "https://h.test/a/b/c.html?q#z", "https://h.test/a/x/y.png?a=../b"),
        ("//O.Test:443/p", "https://h.test/", "https://o.test/p"),
        ("//o.test:80", "http://h.test", "http://o.test/"),
        ("/../../a/..", "https://h.test/x", "https://h.test/"),
        ("a/b/..", "https://h.test/x/", "https://h.test/x/a/"),
        ("?n=1", "https://h.test/x/y?m=2", "https://h.test/x/y?n=1"),
        ("#top", "https://h.test/x?m#a", "https://h.test/x?m"),
        ("\\img\\a.png?b\\c", "https://h.test/x/y", "https://h.test/img/a.png?b\\c"),
        (" HTTPS://Up.Test/A%20b ", None, "https://up.test/A%20b"),
        ("mailto:a@b", "https://h.test/", "mailto:a@b"),
        ("x.png", "about:blank", None),
        ("x.png", None, None),
        ("a//b", "https://h.test", "https://h.test/a//b"),
    ],
)
def test_resolved(spark, raw, base, want):
    df = spark.createDataFrame([(raw, base)], "raw string, base string")
    assert paths.with_resolved(df, "raw", "base").first().resolved == want


def test_in_site_and_back(spark):
    rng = random.Random(3)
    some = lambda: "/".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    rows = [(some(), some() + ".x") for _ in range(200)]
    df = spark.createDataFrame(rows, "f string, t string").select("f", "t", paths.relative(F.col("f"), F.col("t")).alias("way"))
    df = df.withColumn("there", paths.in_site(F.col("way"), F.col("f")))
    for r in df.collect():
        assert r.way == posixpath.relpath(r.t, posixpath.dirname(r.f) or ".") and r.there == r.t
    cases = [("../../x", "a/b", None), ("/x//y/./z?q", "a/b", "x/y/z"), ("a%20b+c%zz", "d/e", "d/a%20b+c%zz"), ("a%20b+c", "d/e", "d/a b+c"), ("?q", "a/b", None), ("..", "a/b/c", "a"), ("..", "a/b", None)]
    got = spark.createDataFrame(cases, "raw string, f string, want string").select("want", paths.in_site(F.col("raw"), F.col("f")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


SITE = {
    "sub/land.html": '<?php x ?><link href="c/a.css" rel=stylesheet><img src="i/a.png"><img srcset="i/a.png 1x,i/a.png.webp 2x"><img src=i/a.png.webp?v=1#f><script src="../x/a.js"></script><p style="background:url(i/a.png)">i/a.png</p><img src="none.png"><img src="../../out.png"><style>@import "c/a.css";</style>',
    "sub/c/a.css": '@import "b.css"; p{background:url("../i/bg.png?1#2")} q{x:url(../i/none.png)}',
    "sub/c/b.css": "@import url('d/c.css');",
    "sub/c/d/c.css": "a{b:url(../a.css)} c{d:url( '../../i/deep.png' )}",  # back to the first
    "sub/i/a.png": "", "sub/i/a.png.webp": "", "sub/i/bg.png": "", "sub/i/deep.png": "", "x/a.js": "", "js/a.js": "already there", "other.html": '<img src="sub/i/a.png">',
}


def test_moves_through_style_sheets_and_circles(spark):
    rows = files(spark, SITE)
    main = spark.createDataFrame([("s", "sub/land.html")], "site_id string, rel_path string")
    moves = saved(sites.moved(rows, main, saved), "moves")
    assert {(r.rel_path, r["round"], r.target) for r in moves.collect()} == {
        ("sub/c/a.css", 1, "css/a.css"), ("sub/i/a.png", 1, "images/a.png"), ("sub/i/a.png.webp", 1, "images/a.png.webp"), ("x/a.js", 1, "js/a_1.js"),
        ("sub/c/b.css", 2, "css/b.css"), ("sub/i/bg.png", 2, "images/bg.png"), ("sub/c/d/c.css", 3, "css/c.css"), ("sub/i/deep.png", 4, "images/deep.png"),
    }
    done = contents(sites.relocated(rows, main, moves))
    assert done["index.html"] == (
        '<link href="css/a.css" rel=stylesheet><img src="images/a.png"><img srcset="images/a.png 1x, images/a.png.webp 2x"><img src="images/a.png.webp?v=1#f"><script src="js/a_1.js"></script>'
        '<p style="background:url(images/a.png)">i/a.png</p><img src="none.png"><img src="../../out.png"><style>@import "css/a.css";</style>'
    )
    assert done["css/a.css"] == '@import "b.css"; p{background:url("../images/bg.png?1#2")} q{x:url(../i/none.png)}'
    assert done["css/b.css"] == "@import url('c.css');" and done["css/c.css"] == "a{b:url(a.css)} c{d:url('../images/deep.png')}"
    assert done["other.html"] == SITE["other.html"] and done["js/a.js"] == "already there" and len(done) == len(SITE)


def test_moves_of_nothing(spark):
    none = spark.createDataFrame([], FILES)
    main = none.select("site_id", "rel_path")
    assert sites.moved(none, main, saved).count() == 0
    assert sites.relocated(none, main, saved(sites.moved(none, main, saved), "m")).count() == 0
    assert sites.repaired(none).count() == 0 and sites.without_deleted(none, main).count() == 0
    blank = files(spark, {"a.html": None, "b.css": None})
    assert sites.references(blank).count() == 0 and contents(sites.without_deleted(blank, main)) == {"a.html": ""}


def test_repair_and_fetching_open_files_once(spark):
    rows = files(spark, SITE)
    plan = sites.repaired(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and sites.repaired(rows).count() > 0
    opened = []
    held = rows.selectExpr("*", "concat('https://s/', rel_path) AS url", "'s' AS main_host")

    def counted(df, tag):
        opened.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return saved(df, tag)

    sites.fetched(held, held.select("site_id", "url"), held.selectExpr("url", "content AS body"), counted, most=1)
    assert sum(opened) == 1


def test_new_names_are_not_replaced_again(spark):
    rows = files(spark, {"p.html": '<img src="a"><img src="b"><img src="ab">', "p.css": "x{y:url(a) url('b') url(\"ab\")}"})
    moves = spark.createDataFrame([("s", p, a, b) for p in ("p.html", "p.css") for a, b in (("a", "b"), ("b", "a"), ("ab", "$1\\a"))], "site_id string, rel_path string, raw string, new string")
    assert contents(sites.rewritten(rows, moves)) == {"p.html": '<img src="b"><img src="a"><img src="$1\\a">', "p.css": "x{y:url(b) url('a') url(\"$1\\a\")}"}


def test_candidates_equal_brute_force(spark):
    rng = random.Random(11)
    folder = lambda: "/".join(rng.choice(["a", "bb", "_external", "c"]) for _ in range(rng.randint(0, 4)))
    there = sorted({posixpath.join(folder(), rng.choice(["x.png", "y.css"])) for _ in range(150)})
    wanted = sorted({(posixpath.join(folder(), rng.choice(["x.png", "p.html"])), rng.choice(["x.png", "y.css", "z.js"])) for _ in range(120)})
    names = spark.createDataFrame([("s", p) for p in there], "site_id string, rel_path string")
    rows = spark.createDataFrame([("s", f, n) for f, n in wanted], "site_id string, from_path string, name string")
    got = {(r.from_path, r["name"]): r.rel_path for r in sites.candidates(names, rows).collect()}

    def best(f, n):
        others = [p for p in there if posixpath.basename(p) == n and p != f]
        key = lambda p: (p.startswith("_external/"), len(posixpath.relpath(p, posixpath.dirname(f) or ".")), p)
        return min(others, key=key, default=None)

    assert got == {(f, n): best(f, n) for f, n in wanted}


def test_deleted_references_both_ways(spark):
    page = '<script src="./x.js?v=3"></script><link href="../a/x.css"/><img src=\'y.gif\'><img src="https://h.test/a/x.js"><a href="x.js">a</a><script src="z.js"></script>'
    rows = files(spark, {"a/p.html": page, "a/q.php": "<?php 1 ?>" + page, "r.html": page, "n.html": None})
    deleted = spark.createDataFrame([("s", "a/x.js"), ("s", "a/x.css"), ("s", "a/y.gif"), ("t", "z.js"), ("s", None)], "site_id string, rel_path string")
    one, two = (sorted(map(tuple, sites.without_deleted(rows, deleted, small).collect())) for small in (1000, 0))
    assert one == two == sorted([("s", "a/p.html", '<img src="https://h.test/a/x.js"><a href="x.js">a</a><script src="z.js"></script>', 3), ("s", "a/q.php", "<?php 1 ?>" + page, 0), ("s", "r.html", page.replace('<link href="../a/x.css"/>', '<link href="../a/x.css"/>'), 0), ("s", "n.html", "", 0)])


@pytest.mark.parametrize("most, rounds", [(1, [1, 1, 1]), (2, [1, 1, 1, 2]), (9, [1, 1, 1, 2, 3])])
def test_fetching_ends(spark, most, rounds):
    page = '<base href="/b/"><link rel=stylesheet href="a.css"><img src="seen.png"><img src="https://o.test/x.png"><script src="gone.js"></script><a href="p.html"><iframe src="q.html"></iframe><img data-src="i.png">'
    held = spark.createDataFrame([("s", "index.html", page, "https://h.test/x/", "h.test")], FILES + ", url string, main_host string")
    seen = spark.createDataFrame([("s", "https://h.test/x/"), ("s", "https://h.test/b/seen.png")], "site_id string, url string")
    had = {"a.css": "@import 'c.css'; @import 'a.css';", "c.css": "x{y:url(f.woff2)} z{w:url(c.css)}", "i.png": "", "f.woff2": ""}
    responses = spark.createDataFrame([(f"https://h.test/b/{n}", c) for n, c in had.items()], "url string, body string")
    got = sites.fetched(held, seen, responses, saved, most).collect()
    assert sorted(r["round"] for r in got) == rounds
    assert {(r.rel_path, r.ok) for r in got if r["round"] == 1} == {("b/a.css", True), ("b/gone.js", False), ("b/i.png", True)}


def test_libraries_get_official_copies(spark):
    page = '<script defer src="js/jquery-3.6.1.min.js" integrity=old></script><link href=/npm/swiper@11.1.4/x.css rel=stylesheet><script src="/npm/evil@1.2.3/x.js"></script><script src="https://cdn.jsdelivr.net/npm/aos@2.3.4/dist/aos.js"></script><noscript><script src="js/jquery-3.6.1.min.js"></script></noscript>'
    rows = spark.createDataFrame([(1, page), (1, page), (None, "<p>"), (2, None)], "page_id long, html string")
    official = spark.createDataFrame([("https://code.jquery.com/jquery-3.6.1.min.js", "sha384-a"), ("https://cdn.jsdelivr.net/npm/swiper@11.1.4/x.css", None), ("https://cdn.jsdelivr.net/npm/evil@1.2.3/x.js", "sha384-e")], "cdn_url string, integrity string")
    found = html.replacements(rows, official)
    assert {r.url for r in found.collect()} == {"js/jquery-3.6.1.min.js", "/npm/swiper@11.1.4/x.css"}
    want = page.replace(' src="js/jquery-3.6.1.min.js" integrity=old', ' src="https://code.jquery.com/jquery-3.6.1.min.js" integrity="sha384-a" crossorigin="anonymous"').replace("href=/npm/swiper@11.1.4/x.css", 'href="https://cdn.jsdelivr.net/npm/swiper@11.1.4/x.css"')
    got = sorted((str(r.page_id), r.html, len(r.changes)) for r in html.pinned(rows, found).collect())
    assert got == sorted([("1", want, 2), ("1", want, 2), ("None", "<p>", 0), ("2", "", 0)])
    second = spark.createDataFrame([("js/jquery-3.6.1.min.js", "https://x.test/j.js", None), ("new", "n", "i")], "url string, cdn_url string, integrity string")
    assert {tuple(r) for r in html.merged(found, second).collect()} == {("js/jquery-3.6.1.min.js", "https://x.test/j.js", None), ("new", "n", "i"), ("/npm/swiper@11.1.4/x.css", "https://cdn.jsdelivr.net/npm/swiper@11.1.4/x.css", None)}


def test_opened_files_hold_only_what_has_addresses(spark):
    """Of a file's elements those with an address or a style come to be read; texts and bare elements don't, and no reference is lost."""
    page = '<html><head><base href="b/"><style>a{background:url(s.png)}</style><script>var x = "y.js"</script></head><p class=c>text<b>more</b><img alt=x><img srcset="one.png 1x, two.png 2x"><i style="background:url(t.png)">u</i><noscript>n<img src=in.gif><p></noscript>'
    rows = files(spark, {"a.html": page, "b.html": None})
    held = {r.rel_path: [e.tag for e in r.elements] for r in sites._opened(rows).collect()}
    assert held == {"a.html": ["base", "style", "img", "i", "img"], "b.html": []}
    assert {r.raw for r in sites.references(rows).collect()} == {"s.png", "one.png", "two.png", "t.png", "in.gif"}
    moves = spark.createDataFrame([("s", "a.html", n, "new-" + n) for n in ("s.png", "one.png", "t.png", "in.gif")], "site_id string, rel_path string, raw string, new string")
    want = page.replace("s.png", "new-s.png").replace(' srcset="one.png 1x, two.png 2x"', ' srcset="new-one.png 1x, two.png 2x"').replace("t.png", "new-t.png").replace(" src=in.gif", ' src="new-in.gif"')
    assert contents(sites.rewritten(rows, moves)) == {"a.html": want, "b.html": None}
