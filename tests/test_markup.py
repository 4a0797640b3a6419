"""The tokenizer against markup that browsers run, its time, and edits put into long pages."""

import time

import pyarrow as pa
import pytest

from pagemill.operators import adapt, extract, html, markup
from pagemill.sources import batches as small


def attrs(text, tag=None):
    return [(e["tag"], [(a["name"], a["value"]) for a in e["attrs"]]) for e in markup.elements_of(text) if e["tag"] != "#text" and tag in (None, e["tag"])]


@pytest.mark.parametrize(
    "text, want",
    [
        ('<img/src="https://evil.test/x.gif">', [("img", [("src", "https://evil.test/x.gif")])]),
        ('<img src="a.png"onerror="f(\'x\')">', [("img", [("src", "a.png"), ("onerror", "f('x')")])]),
        ("<script src=https://evil.test/a.js?it's></script>", [("script", [("src", "https://evil.test/a.js?it's")])]),
        ('<a href=https://evil.test/"x>', [("a", [("href", 'https://evil.test/"x')])]),
        ("<a href = x / title=y/ b>", [("a", [("href", "x"), ("title", "y/"), ("b", "")])]),
        ("<p =x a==b c='>' d=>", [("p", [("=x", ""), ("a", "=b"), ("c", ">"), ("d", "")])]),
        ('<p title="no end><b>', []),
        ("<!--><b><!-- --!><i><!---><u>", [("b", []), ("i", []), ("u", [])]),
        ("<!doctype html><?x y><![CDATA[<b>]]></ x><em>", [("em", [])]),
        ("<A\nHREF=&quot;x&amp;y>", [("a", [("href", '"x&y')])]),
    ],
)
def test_attributes_as_browsers_read_them(text, want):
    assert attrs(text) == want


def test_raw_content_ends_where_browsers_end_it():
    found = markup.elements_of("<script>a</scripty></script foo='>'><b>c</b><style>x")
    assert [(e["tag"], e["body"]) for e in found] == [("script", "a</scripty>"), ("b", None), ("#text", "c"), ("style", "x")]


def test_numbers_name_the_element_around():
    found = {e["number"]: e for e in markup.elements_of("<picture><source><p><img></p></i><img></picture><noscript> <img> x</noscript>")}
    up = [(e["tag"], found[e["up"]]["tag"] if e["up"] >= 0 else "") for e in found.values()]
    assert up == [("picture", ""), ("source", "picture"), ("p", "picture"), ("img", "p"), ("img", "picture"), ("noscript", ""), ("img", "noscript")]
    assert found[5]["body"].split() == ["x"]


def test_wanted_elements_and_attributes_only():
    text = '<p class="a"><a href="x" id="i">t</a><noscript><img src="n" id="j"></noscript></p>'
    assert attrs(text, "a") == [("a", [("href", "x"), ("id", "i")])]
    found = markup.elements_of(text, ("a", "img"), ("href", "src"))
    assert [(e["tag"], e["within"], [(a["name"], text[a["start"] : a["stop"]]) for a in e["attrs"]]) for e in found] == [("a", "p", [("href", ' href="x"')]), ("img", "noscript", [("src", ' src="n"')])]


@pytest.mark.parametrize("text", ["<a " * 100_000, "</b>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<a href='" * 50_000, "<!-" * 200_000, "<p a=" * 100_000, "<a b=c>x</a>" * 40_000, "<script>" + "</scrip" * 100_000])
def test_time_is_linear(text):
    start = time.process_time()
    markup.elements_of(text)
    assert time.process_time() - start < 4


def test_splicing_is_linear():
    text = "<a href=x>" * 200_000
    start = time.process_time()
    edits = markup.outermost([{"start": 10 * i + 2, "stop": 10 * i + 9, "new": " href=y"} for i in reversed(range(200_000))])
    assert markup.spliced(text, edits) == "<a href=y>" * 200_000
    assert time.process_time() - start < 4


def test_outermost_edits():
    e = lambda a, b, n: {"start": a, "stop": b, "new": n}
    assert markup.outermost([e(5, 9, "in"), e(3, 12, "out"), e(3, 3, "at"), e(12, 12, "end"), e(3, 5, "short")]) == [e(3, 3, "at"), e(3, 12, "out"), e(12, 12, "end")]


def test_a_long_page_is_cleaned(spark):
    page = "<html><head></head>" + '<p onclick="fetch(\'https://a.test\')"><a href="https://shop.test/x?a=1">text {macro_x}</a><img src=https://evil.test/a.png></p>' * 8_000
    start = time.time()
    (row,) = html.cleaned(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert row.n_edits == 32_000 and row.html.count('<p><a href="{offer}">text </a></p>') == 8_000
    assert time.time() - start < 60


PAGES = [
    ('<a href="{offer}"><img src="p.png" srcset="q 2x"><img src="logo.png"></a>', '<a href="{offer}"><img src="T&amp;"><img src="logo.png"></a>'),
    ('<picture><source srcset="{x}"><img alt="a"></picture><source srcset="{y}" sizes=9>', '<picture><img src="T&amp;" alt="a"></picture><source srcset="T&amp;">'),
    ("<p style=\"a:url( '{bg}' ) url(x)\">", "<p style=\"a:url('T&amp;') url(x)\">"),
    ('<img src="old"><img src="T&amp;" srcset="{z}"><a href="{offer}"><b><img width=48><img width=49></b></a>', '<img src="T&amp;"><img src="T&amp;" srcset="{z}"><a href="{offer}"><b><img width=48><img src="T&amp;" width=49></b></a>'),
    (None, ""),
    ('<a href="{offer}"></a><img src=x.png><noscript><img src="{n}"></noscript>', None),
]


def test_images_and_a_second_run(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PAGES)], "page_id long, html string")
    first = adapt.images_replaced(rows, "T&", ["old", "T&"])
    assert {r.page_id: r.html for r in first.collect()} == {i: a if b is None else b for i, (a, b) in enumerate(PAGES)}
    again = adapt.images_replaced(first, "T&", ["old", "T&"])
    assert {(r.page_id, r.html, len(r.changes)) for r in again.collect()} == {(i, a if b is None else b, 0) for i, (a, b) in enumerate(PAGES)}
    assert [(c.element, c.before, c.trigger) for c in next(r.changes for r in first.collect() if r.page_id == 3)] == [("img", "old", "re-point"), ("img", "", "offer-anchor")]


def test_pages_reach_python_in_small_parts(spark):
    """Whatever the batch, few pages at a time are Python objects, and a batch that Spark sends is small."""
    sizes = [10, None, 300_000, 5, 200_000, 100_000, *[3_000] * 1_000]
    batch = pa.RecordBatch.from_pydict({"html": pa.array([None if n is None else "x" * n for n in sizes], pa.string())})
    parts = [p.column("html").to_pylist() for p in small.slices(batch, "html")]
    assert [x for p in parts for x in p] == batch.column("html").to_pylist()
    assert all(len(p) == 1 or len(p) <= 256 and sum(len(x or "") for x in p) <= 256 << 10 for p in parts)
    assert [len(p) for p in small.slices(batch, "none")] == [256, 256, 256, 238] and list(small.slices(batch.slice(0, 0), "html")) == []
    for name in small.BATCH:
        spark.conf.unset(name)
    rows = spark.range(3).selectExpr("id AS page_id", "'<p>a' AS html")
    assert markup.elements(rows, ("p",)).count() == 3
    assert all(int(spark.conf.get(name)) <= int(most) for name, most in small.BATCH.items())


def test_only_what_can_hold_an_address_leaves_python(spark):
    """Without `bare`, elements with one of the attributes and styles are those of a full reading; texts, scripts and elements without any stay behind."""
    text = "a<p>b<img src=i><img alt=x><script>f()</script><script src=s>g()</script><style>c</style><title>t</title><a href>e</a><noscript>n<img src=o><img></noscript></p>"
    full = markup.elements_of(text, names=("src", "href"))
    some = markup.elements_of(text, names=("src", "href"), bare=False)
    plain = lambda found: [(e["tag"], e["start"], e["inner"], e["stop"], e["body"], e["within"], e["attrs"]) for e in found]
    assert plain(some) == plain([e for e in full if e["attrs"] or e["tag"] == "style"])
    assert [e["tag"] for e in some] == ["img", "script", "style", "a", "img"]
    pages = spark.createDataFrame([(1, text), (2, None), (3, "x")], "page_id long, html string")
    sent = lambda df: {r.page_id: len(r.elements) for r in df.collect()}
    assert sent(markup.with_elements(pages, names=("src", "href"), bare=False)) == {1: 5, 2: 0, 3: 0}
    assert [(r.kind, r.url) for r in extract.resources(pages).collect()] == [("img", "i"), ("script", "s"), ("anchor", "")]
