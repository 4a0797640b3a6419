"""Aliases of sinks, settings from JSON, errors of single pages, styles put together."""

import pytest

from pagemill.functions import policy
from pagemill.operators import html, markup, report, scripts, sites
from pagemill.sources import config
from pagemill.sources.tables import saved

SCRIPTS = "page_id long, number int, body string"


@pytest.mark.parametrize(
    "body, want",
    [
        ("var f = fetch; g = f; g('https://a.test')", [("g", "fetch", "https://a.test")]),
        ("h=g;\ng=f;\nf=window.fetch\nh('x')", [("h", "fetch", "x")]),
        ("a = b; b = a; a('x')", []),
        ("function fetch(){} var f = fetch; f('x')", []),
        ("var f = fetch; function f(){} f('x')", []),
        ("var s = navigator.serviceWorker; s.register(`w`); o.s('no'); sf('no')", [("s", "navigator.serviceWorker", "w")]),
        ("f == fetch; f('x'); var h = fetch('y'); h('z')", []),
        (None, []),
    ],
)
def test_aliases(spark, body, want):
    rows = spark.createDataFrame([(1, 0, body), (1, 1, "f('other script')")], SCRIPTS)
    assert [(r.name, r.sink, r.target) for r in scripts.aliased_calls(rows, saved).collect()] == want


def test_a_long_chain_of_aliases(spark):
    body = "; ".join(f"n{i} = n{i - 1}" for i in range(12, 0, -1)) + "; n0 = fetch; n12('far')"
    assert [(r.name, r.target) for r in scripts.aliased_calls(spark.createDataFrame([(None, 3, body), (2, 3, body)], SCRIPTS), saved).collect()] == [("n12", "far")]  # null page_ids have no script to belong to


def test_settings(spark):
    files = {
        "full": '{"defaultVertical": "X", "nameMacro": "{n}", "verticals": {"X": {"imageBase": "b"}, "Adult": {"imageBase": "a", "y": [1]}}, "other": {}}',
        "none": None, "torn": '{"defaultVertical"', "list": "[]", "text": '"x"', "types": '{"defaultVertical": 1, "nameMacro": "", "verticals": []}', "null": '{"nameMacro": null}', "base": '{"verticals": {"X": {"base": "b"}}}', "empty": "{}",
    }
    found = config.settings(spark.createDataFrame(list(files.items()), "site_id string, content string"))
    got = {r.site_id: (r.default_vertical, r.name_macro, r.source, r.problems) for r in found.collect()}
    own = (config.BUILTIN["default_vertical"], config.BUILTIN["name_macro"])
    assert got == {
        "full": ("X", "{n}", "file", []), "none": (*own, "builtin", []), "torn": (*own, "builtin", ["not JSON"]), "list": (*own, "builtin", ["not an object"]), "text": (*own, "builtin", ["not an object"]),
        "types": (*own, "builtin", ["defaultVertical: no text", "nameMacro: no text", "verticals: no image bases"]), "null": (*own, "builtin", ["nameMacro: no text"]), "base": (*own, "builtin", ["verticals: no image bases"]), "empty": (*own, "file", []),
    }
    maps = {r.site_id: r.verticals for r in found.collect()}
    assert {k: maps["full"][k] for k in ("X", "Adult")} == {"X": "b", "Adult": "a"} and len(maps["full"]) == 3 and len(maps["torn"]) == 2


def test_one_broken_page_leaves_the_others(spark, monkeypatch):
    rows = spark.createDataFrame([(1, '<img src="https://evil.test/a.png">ok'), (2, "<p>" * 40), (3, None)], "page_id long, html string")
    done = html.cleaned_or_error(rows, "", longest=100)
    assert {r.page_id: (r.html, r.n_edits) for r in done.collect()} == {1: ("ok", 1), 2: ("<p>" * 40, 0), 3: ("", 0)}
    assert [tuple(r) for r in html.error_log(done).collect()] == [(2, "markup", "OverflowError", "more than 100 characters")]
    assert html.error_log(html.cleaned_or_error(rows, policy.POLICY_TAG)).count() == 0


def test_wanted_elements_keep_errors_apart(spark):
    rows = markup.with_elements_or_error(spark.createDataFrame([(1, "<a href=x>"), (2, "<a>" * 50)], "page_id long, html string"), ("a",), ("href",), longest=20)
    assert {r.page_id: (len(r.elements), r.error and r.error.kind) for r in rows.collect()} == {1: (1, None), 2: (0, "OverflowError")}


def test_held_nodes_keep_their_text(spark):
    long = '<iframe src="https://evil.test/">' + "x" * 3000 + "</iframe>"
    rows = spark.createDataFrame([(1, f'<p>{long}<a href="javascript:x()">y</a><img src="https://www.googletagmanager.com/a.gif"></p>'), (2, None)], "page_id long, html string")
    got = sorted((r.page_id, r.number, r.reason, r.snippet, len(r.shown)) for r in html.held(rows).collect())
    assert got == [(1, 1, "iframe", long[:2000], 300), (1, 2, "dangerous link", ' href="javascript:x()"', 22)]


def test_sections_dead_scripts_and_routes(spark):
    changes = spark.createDataFrame([("remove", "a")] * 103 + [("quarantine", "b"), ("keep", "c")], "action string, reason string")
    assert {tuple(r) for r in report.change_sections(changes).collect()} == {("a", 103, 100, "... and 3 more"), ("b", 1, 1, None)}
    code = {"a.js": "$('x').y()", "b.js": "x.onload = f", "c.js": "x.on == y; f()", "d.js": None, "e.js": "el.addEventListener ('x')", "f.js": "f()"}
    files = spark.createDataFrame([("s", p, c) for p, c in code.items()], "site_id string, rel_path string, content string")
    ran = spark.createDataFrame([("s", p, 2.0 if p == "f.js" else 0.5) for p in code] + [("s", None, 0.0), ("s", "gone.js", 0.0)], "site_id string, rel_path string, percent double")
    assert {r.rel_path: r.is_dead for r in report.dead_files(ran, files).collect()} == {"a.js": False, "b.js": False, "c.js": True, "d.js": True, "e.js": False}
    paths = {"a.HTML": "x", "b.php": "<?php", "c.inc": "<% x %>", "d.inc": "x", "e.css": "", "f.mjs": None, "g.svg": "", "h.js.map": "", "i": "<?="}
    rows = spark.createDataFrame([("s", p, c) for p, c in paths.items()], "site_id string, rel_path string, content string")
    assert {r.rel_path: r.route for r in sites.routed(rows).collect()} == {"a.HTML": "page", "b.php": "server page", "c.inc": "server page", "d.inc": "none", "e.css": "style", "f.mjs": "script", "g.svg": "vector", "h.js.map": "map", "i": "none"}
