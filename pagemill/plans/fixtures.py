"""Small tables for the queries whose markup or records the pages don't have: one definition for Spark and for the oracle."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
SQL_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass
class Fixture:
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        """The rows from an Arrow table, which lie in the plan: those of a list would be read by Python workers, which live on beside those of the pages."""
        names, kinds = zip(*(c.split() for c in self.schema.split(", ")))
        columns = [pa.array(values, ARROW_TYPES[kind]) for values, kind in zip(zip(*self.rows), kinds)]
        return spark.createDataFrame(pa.table(columns, names=names))

    def sql(self) -> str:
        """A parenthesised SELECT with the same rows."""
        columns = [c.split() for c in self.schema.split(", ")]

        def literal(v: object, kind: str) -> str:
            text = "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
            return f"CAST({text} AS {SQL_TYPES[kind]})"

        values = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, columns)) + ")" for row in self.rows)
        return f"(SELECT * FROM (VALUES {values}) AS t({', '.join(c for c, _ in columns)}))"


SNIPPETS = Fixture(
    "slot int, markup string",
    [
        (0, '<script src="https://cdn.jsdelivr.net/npm/jquery@3.6.1/dist/jquery.min.js"></script><img src="/img/a.png"><a href="https://shop.test/buy?utm_x=1">x</a><img/src="https://evil.test/x.gif">'),
        (1, '<script src="https://www.googletagmanager.com/gtm.js?id=1"></script><iframe src="//ads.unknown.test/frame"></iframe><img src="https://px.ads.linkedin.com/c.gif"><img src="b.png"onerror="fetch(\'https://evil.test\')">'),
        (2, '<link rel="stylesheet" href="https://fonts.googleapis.com/css?family=A"><img src="data:image/png;base64,AAAA"><a href="javascript:void(0)">y</a><script src=https://evil.test/a.js?it\'s></script><a href=https://evil.test/"x>q</a>'),
        (3, '<script src="https://cdn.jsdelivr.net/gh/someone/repo/x.js"></script><video src="blob:https://a/b"></video><script src="js/pixel-tracker.js"></script><script>var a = 1</script foo><b>after</b>' + '<meta http-equiv="refresh" content="1"><object data="x"></object><embed src="https://evil.test/e.swf"><frameset></frameset>'),
        (4, '<script>window.dataLayer = []; gtag("js"); fetch("https://x.test/a"); atob("aGk=")</script><meta name="google-site-verification" content="1"><a href="{sub_id}">m</a><!-- <script>gtag()</script> --><script data-src="a">fetch(1)</script>'),
        (5, '<div onclick="fetch(\'https://evil.test\')" onload="init()">{offer} {foreign_macro}</div><style>@import url("https://evil.test/a.css"); b{background:url(https://evil.test/i.png)}</style>'),
        (6, "<script src='https://single.test/a.js'></script><img src=https://bare.test/b.gif><!-- <script src='https://comment.test/c.js'></script> -->" + '<script src="https://unpkg.com/@popperjs/core@2/dist/umd/popper.min.js"></script><link rel="stylesheet" href="https://cdn-like.test/x.css"><img src="https://assets.example.com/a.png">' + '<script type="application/ld+json">{"a":"google-analytics"}</script><noscript><img src="//unlisted.test/p"></noscript><noscript>text<img src="//unlisted.test/p"></noscript><base href="/b/">'),
    ],
)
# Images of products, pictures and styles; # is the page's number.
IMAGES = Fixture(
    "slot int, markup string",
    [
        (0, '<a href="{offer}"><img class="pack" src="img/pack-#.png" srcset="img/pack-#@2x.png 2x" alt="p"><img src="img/logo.png"><img src="i/tick.svg?v=1"><img src="t.png" width="32px"></a>'),
        (1, '<picture><source srcset="{img_#}"><source srcset="b.webp" media="(x)"><img src="c-#.png" sizes="9"></picture><img src="plain-#.png">'),
        (2, '<video><source src="{vid}"></video><source data-src="{late}" srcset="x-#.png">'),
        (3, '<div style="color:red;background:url(\'{bg_#}\') no-repeat, url(own.png)">x</div><p style="background:url(https://assets.example.com/WeightLoss/{_offer_value:offerimage})">y</p>'),
        (4, '<img src="https://assets.example.com/WeightLoss/{_offer_value:offerimage}"><img src="https://assets.example.com/Adult/{_offer_value:offerimage}"><a href="{offer}"><img src="https://assets.example.com/Adult/{_offer_value:offerimage}" srcset="z 1x"></a>'),
        (5, '<a href="{offer}"><picture><source srcset="s.webp"><img data-src="late-#.jpg" class="icon-x"><img data-src="big-#.jpg"></picture></a><noscript><img src="{n}"></noscript>'),
        (6, '<a href="/x"><img src="{click}.png" poster="{p}"></a><img alt="visa #" src="v.png"><picture><img src="own-#.png"><source srcset="{behind}"></picture>'),
    ],
)
# References of a saved page to other files of its site, and these files (paths from the page's folder); # is the page's number.
LINKED = Fixture(
    "slot int, markup string",
    [
        (0, '<link rel="stylesheet" href="css/main-#.css"><script src="../lib/app-#.js?v=2"></script><img src="img/a-#.png" srcset="img/a-#.png 1x, img/a-#-2.png 2x"><img src="img/a-#.png.webp"><img src="./img//a-#.png">'),
        (1, '<style>@import "st-#.css"; b{background:url(x/bg-#.png)}</style><div style="background:url(\'x/bg-#.png\')">.</div><video poster="poster-#.jpg"><source src="v-#.mp4"></video><img data-src="lazy-#.png" src="data:image/gif;base64,AA">'),
        (2, '<img src="https://cdn.other.test/z/pic-#.png"><img src="//x.test/none-#.png"><link href="theme.css"><script src="/lib/app-#.js"></script><a href="doc-#.html">d</a><img src="gone-#.png"><img src="https://x.test/">'),
        (3, '<base href="/root/"><img src="b-#.png"><script src="deleted-#.js?x=1"></script><link rel="stylesheet" href="./deleted-#.css"><img src="kept-#.png"><img src="sub/../deleted-#.gif">'),
        (4, '<?php echo 1 ?><script src="deleted-#.js"></script><img src="../../../../../out-#.png">'),
        (5, '<script src="js/jquery-3.6.1.min.js"></script><script src="/ajax/libs/vue/3.2.1/vue.min.js"></script><link rel="stylesheet" href="npm/swiper@11.1.4/swiper-bundle.min.css"><script src="https://cdn.jsdelivr.net/npm/aos@2.3.4/dist/aos.js"></script><script src="https://old.test/npm/gsap@3.12.2/dist/gsap.min.js"></script><script src="/npm/evil@1.2.3/x.js"></script><script src="js/own-#.js"></script>'),
        (6, '<iframe src="frame-#.html"></iframe><img src="../../img/up-#.png"><svg><use href="sprite-#.svg#i"></use></svg><img src="a%20b-#.png"><noscript><img src="ns-#.png"></noscript><img src="/./x/../img/root-#.png?a=1#f">'),
    ],
)
ASSETS = Fixture(
    "slot int, path string, body string",
    [
        (0, "css/main-#.css", "p{background:url(\"../img/bg-#.png?x=1#y\")} @font-face{src:url(fonts/f-#.woff2)} i{b:url(sub/theme-#.css)} j{b:url(data:image/png;base64,AA)}"),
        (0, "css/sub/theme-#.css", "a{b:url(deep-#.css)}"), (0, "css/sub/deep-#.css", "c{d:url('theme-#.css')} e{f:url(../../img/late-#.png)} g{h:url(missing-#.png)}"),
        (0, "img/bg-#.png", ""), (0, "img/late-#.png", ""), (0, "css/fonts/f-#.woff2", ""), (0, "img/a-#.png", ""), (0, "img/a-#-2.png", ""), (0, "img/a-#.png.webp", ""), (0, "../lib/app-#.js", "1"), (0, "../../images/a-#.png", ""),
        (1, "st-#.css", "@import 'more-#.css';"), (1, "more-#.css", ""), (1, "x/bg-#.png", ""), (1, "poster-#.jpg", ""), (1, "old/lazy-#.png", ""), (1, "old/older/lazy-#.png", ""), (1, "media/v-#.mp4", ""),
        (2, "media/pic-#.png", ""), (2, "../../_external/cdn.other.test/pic-#.png", ""), (2, "../../_external/x.test/none-#.png", ""), (2, "js/app-#.js", ""), (2, "../theme.css", ""),
        (3, "deleted-#.js", ""), (3, "deleted-#.css", ""), (3, "deleted-#.gif", ""), (3, "kept-#.png", ""), (4, "deleted-#.js", ""),
        (5, "js/own-#.js", "document.addEventListener('x', f); a == b"), (5, "js/lib.inc", "<?php x ?>"), (5, "js/part-#.phtml", "plain"), (5, "js/own-#.js.map", "{}"), (5, "js/jquery-3.6.1.min.js", ""), (6, "frame-#.html", "<img src=inner-#.png>"), (6, "inner-#.png", ""), (6, "sprite-#.svg", "<svg onload=\"x()\"><script>a</script><a xlink:href=\"https://evil.test/#\">b</a><use href='#'/><style>c{d:url(https://evil.test/s.png)}</style></svg>"), (6, "a b-#.png", ""), (6, "../../img/up-#.png", ""),
    ],
)
# Files of code beside each page; # is the page's number.
CODE_FILES = Fixture(
    "slot int, path string, body string",
    [
        (0, "js/a-#.js", "var u = \"{sub_#}x{sub_#}\" + '{offer}{offer}'; var o = {a:1}; //# sourceMappingURL=a-#.js.map"), (0, "js/a-#.js.map", "{}"),
        (1, "css/s-#.css", "a{background:url('{bg_#}?x={bg_#}')} b{background:url({_offer_value:offerimage})} c{d:{e}} /*# sourceMappingURL=s.css.map */"),
        (2, "js/m-#.mjs", "let t = `a{x_#}b ${c} {y.z}`; t += '{x_#}' //@ sourceMappingURL = m.map"),
        (3, "css/none.css", "p{color:red}"), (3, "js/none-#.js", "f({a})"), (4, "css/t-#.CSS", "p{a:URL({a_#})} q{b:url(\"{b_#}\")} r{c:url({offer})} s{d:url({offer})}"),
        (5, "data-#.json", '{"a":"{b}"} //# sourceMappingURL=x.map'), (6, "lib-#.MAP", "{}"), (6, "i/#.png", ""), (6, "f/#.woff2", ""), (6, "v/#.mp4", ""),
    ],
)
# Server code, scripts, styles, links and macros; # is the page's number.
CODE = Fixture(
    "slot int, markup string",
    [
        (0, "<?php eval($_POST['x']); ?><p>a</p><link rel=preload as=script href=https://www.googletagmanager.com/gtm.js><link rel=icon href=https://evil.test/i.ico><script>var _0x1a=_0x2b;_0x3c(_0x4d);//@ sourceMappingURL=a-#.js.map</script>"),
        (1, "<b>k</b><?= 1 ?><link rel='alternate stylesheet' href='https://evil.test/b.css'><script>eval(function(p,a,c,k,e,d){return p}('x',1,1,''))</script><style>@import 'https://evil.test/a.css'; a{background:url(\"https://evil.test/x-#.png\")} b{background:url(i/y.png)}</style>"),
        (2, "<% x %>y<link rel='preload' as='image' href='https://evil.test/a.png'><link rel='dns-prefetch' href='//mc.yandex.ru'><script>/*! jQuery JavaScript Library v3.7.1 */ var a=#;</script><style>@import url('https://fonts.googleapis.com/css2?family=A:wght@400;700&display=swap'); a{color:red}</style>"),
        (3, "<script>/* Lodash 4.17.21 (Custom Build) */</script><link rel='modulepreload' href='https://unpkg.com/aos@2/a.js'><style>@import url('https://evil.test/css?a=1;2');c{color:red}</style><p>{sub_#} b {offer}</p><a href='{click_id}'>m</a>"),
        (4, "<script>gzinflate(base64_decode('eA==')); move_uploaded_file($a, $b);</script><link rel='preload' as='font' href='https://fonts.gstatic.com/a.woff2'><script>var m=\"{js_#}\"+'{offer}';</script><img src='{img_#}' alt='x'><div style='background:url({bg_#})' data-x='{d}'>z</div>"),
        (5, "<script src='https://code.jquery.com/jquery-3.6.1.min.js'></script><script src='js/bootstrap.min.js'></script><link rel='stylesheet' href='https://x.test/npm/swiper@11.1.4/swiper-bundle.min.css'><script src='https://cdn.fake.test/gsap/3.12.2/gsap.min.js?x=#'></script><script>var total = price * count;</script>"),
        (6, "<script>preg_replace('/x/e', $a, $b);//@ sourceMappingURL = b.map</script><?php system($_GET['c']); echo 1"),
    ],
)
# Scripts whose names stand for what sends; # is the page's number.
ALIASES = Fixture(
    "slot int, markup string",
    [
        (0, "<script>var f = fetch; let g = f; g('https://evil.test/#'); gg('https://no.test/')</script>"),
        (1, '<script>const W = window.WebSocket;\nnew W("wss://evil.test/#");</script>'),
        (2, "<script>function fetch(u){return u} var f = fetch; f('https://evil.test/');</script>"),
        (3, "<script>a = b; b = c; c = a; a('https://evil.test/'); d = e; e = fetch; d('https://late.test/#')</script>"),
        (4, "<script>var s = navigator.serviceWorker; s.register('/sw-#.js');</script>"),
        (5, "<script>var x = self.fetch, y = x; y(`https://evil.test/t`); x.y('https://no.test/')</script>"),
        (6, "<script>var f = fetch;</script><script>f('https://other.test/'); function h(){} var h = fetch; h('https://own.test/')</script>"),
    ],
)
CONFIGS = Fixture(
    "slot int, markup string",
    [
        (0, '{"defaultVertical": "WeightLoss", "nameMacro": "{name_#}"}'), (1, '{"defaultVertical": '), (2, '{"defaultVertical": 5, "nameMacro": "{n}"}'),
        (3, '{"verticals": {"Adult": {"imageBase": "https://assets.example.com/new/#"}, "Crypto": {"imageBase": "https://assets.example.com/c", "x": 1}}, "more": [1]}'), (4, "[1, 2]"), (5, '{"verticals": {"Adult": {"imageBase": ""}}, "nameMacro": null}'), (6, "{}"),
    ],
)
FILES = Fixture(
    "site_id int, rel_path string, content string, size long",
    [
        (1, "index.html", "<title>Home</title><h1>a</h1><form action=x></form><script src=a></script>", 20000),
        (1, "about/index.html", "<title>About</title><img src=b>", 5000),
        (1, "landing.php", "<title>L</title>{offer}", 900),
        (1, "img/logo.png", "", 4000),
        (1, "deep/img/logo.png", "", 4100),
        (1, "_external/cdn.x.test/logo.png", "", 4200),
        (2, "page.htm", "<title> </title><h1 class=x>b</h1>", 300),
        (2, "other.htm", "<h1 class=x>b</h1>", 300),
        (2, "fonts/a.woff2", "", 100),
        (2, "x/a.woff2", "", 100),
        (2, "data.bin", "", 1),
    ],
)
SPANS = Fixture(
    "file string, start_pos int, end_pos int, hits int",
    [("a.js", 0, 10, 1), ("a.js", 10, 20, 2), ("a.js", 15, 18, 1), ("a.js", 30, 40, 1), ("a.js", 32, 36, 0), ("b.js", 5, 9, 1), ("b.js", 5, 9, 3), ("b.js", 7, 30, 1), ("b.js", 50, 60, 0), ("c.js", 1, 2, 0)],
)
REQUESTS = Fixture(
    "page string, profile string, url string, is_error boolean",
    [
        ("index.html", "desktop", "https://cdn.jsdelivr.net/npm/jquery@3/x.js", False),
        ("index.html", "desktop", "https://evil.test/a.js", False),
        ("index.html", "mobile", "/local.css", False),
        ("about.html", "desktop", "https://evil.test/a.js", True),
        ("about.html", "mobile", "https://fonts.gstatic.com/f.woff2", False),
    ],
)
LINKS = Fixture(
    "case_id int, rel string, as_attr string, href string",
    [(1, "stylesheet", None, "https://fonts.googleapis.com/css"), (2, "preload", "script", "https://www.googletagmanager.com/gtm.js"), (3, "preload", "image", "https://evil.test/a.png"), (4, "dns-prefetch", None, "//mc.yandex.ru"), (5, "alternate stylesheet", None, "https://evil.test/b.css"), (6, "icon", None, "https://evil.test/i.ico"), (7, "modulepreload", None, "https://unpkg.com/aos@2/a.js"), (8, "preload", "font", "https://fonts.gstatic.com/a.woff2")],
)
LIB_URLS = Fixture(
    "case_id int, url string",
    [(1, "https://code.jquery.com/jquery-3.6.1.min.js"), (2, "/ajax/libs/jquery/3.6.1/jquery.js"), (3, "https://x.test/npm/swiper@11.1.4/swiper-bundle.min.css"), (4, "jquery.validate.min.js"), (5, "js/bootstrap.min.js"), (6, "https://cdn.fake.test/gsap/3.12.2/gsap.min.js?x=1"), (7, "lib/aos-2.3/aos.js")],
)
SOURCES = Fixture(
    "case_id int, code string",
    [
        (1, "<?php eval($_POST['x']); ?><p>a</p>"), (2, "<?xml version='1.0'?><b>k</b><?= 1 ?>"), (3, "<% x %>y<?php echo 1"), (4, "plain {offer} {x.y} {bad macro} {x.y}"),
        (5, "var _0x1a=_0x2b;_0x3c(_0x4d);"), (6, "eval(function(p,a,c,k,e,d){return p}('x',1,1,''))"), (7, "gzinflate(base64_decode('eA==')); move_uploaded_file($a, $b);"), (8, "var total = price * count;"),
        (9, "/*! jQuery JavaScript Library v3.7.1 */"), (10, "/* Lodash 4.17.21 (Custom Build) */"), (11, "@import 'https://evil.test/a.css'; a{background:url(\"https://evil.test/x.png\")} b{background:url(i/y.png)}"),
        (12, "@import url('https://fonts.googleapis.com/css2?family=A:wght@400;700&display=swap'); a{color:red}"), (13, "@import url('https://evil.test/css?a=1;2');c{color:red}"),
    ],
)
CONFIG = Fixture("layer int, default_vertical string, name_macro string", [(0, "general", "{_offer_value:offername}"), (1, None, "{name}"), (2, "health", None)])
BRIEF = Fixture("case_id int, vertical string, image_mode string, image_file string", [(1, None, "macro", None), (2, "Adult", "macro", None), (3, " WeightLoss ", "file", "img/p.png"), (4, "Adult", "skip", None), (5, "None", "macro", None)])
# Pages for the passes of cleaning, and what becomes of them with "<meta policy>" as the policy tag.
DIRTY = Fixture(
    "page_id long, html string",
    [
        (1, '<html><head><meta charset="u"><base href="x"><title>{foo}a</title></head><body><p>a  {sub_id}  b {offer}</p></body></html>'),
        (1, "<html><p>a</p><noscript><img src='//unlisted.test/p'></noscript><noscript><img src=\"/own.png\"><iframe src=https://www.googletagmanager.com/ns.html></iframe></noscript></html>"),
        (None, '<p><base href="y"><a href="{click_id}">m</a><a href="tel:1">t</a><img src="{img}" alt="x"></p>'),
        (2, "no markup {x}"),
        (3, "<head></head><style>@import 'https://fonts.googleapis.com/css2?family=A:wght@400;700';@import '//evil.test/a;b.css';p{color:red}</style><pre>{keep}</pre><script>var a = \"{js_macro}\" + '{offer}';</script><div style=\"background:url({bg})\" data-x=\"{d}\"></div>"),
        (4, None),
    ],
)
CLEANED = Fixture(
    "page_id long, html string, n_edits long",
    [
        (1, '<html><head><meta charset="u"><meta policy><title>a</title></head><body><p>a b {offer}</p></body></html>', 4),
        (1, "<html><head><meta policy></head><p>a</p><noscript><img src=\"/own.png\"></noscript></html>", 3),
        (None, '<head><meta policy></head><p><a href="{offer}">m</a><a href="tel:1">t</a><img src="{img}" alt="x"></p>', 3),
        (2, "no markup ", 1),
        (3, "<head><meta policy></head><style>@import 'https://fonts.googleapis.com/css2?family=A:wght@400;700';p{color:red}</style><pre>{keep}</pre><script>var a = \"{js_macro}\" + '{offer}';</script><div style=\"background:url({bg})\" data-x=\"{d}\"></div>", 2),
        (4, "", 0),
    ],
)
FLAGS = Fixture(
    "page_id long, kind string, token string, element string, attr string",
    [
        (1, "text", "{foo}", "text<title>", "(text)"), (1, "text", "{sub_id}", "text<p>", "(text)"), (1, "own", "{offer}", "text<p>", "(text)"), (None, "link", "{click_id}", "a", "href"), (None, "image", "{img}", "img", "src"),
        (2, "text", "{x}", "text<>", "(text)"), (3, "script", "{js_macro}", "script", "(js-string)"), (3, "own", "{offer}", "script", "(js-string)"), (3, "image", "{bg}", "div", "style"), (3, "other", "{d}", "div", "data-x"),
    ],
)
NAMED = Fixture(
    "page_id long, html string",
    [(1, '<p class="foo" title="Foo &amp; co">FOO, Vital  Boost<a href="/foo/x.js">food</a></p><script>var foo=1</script>'), (1, '<meta name="Description" content="the foo"><meta name="author" content="foo"><code>foo</code><title>foo</title>'), (None, None)],
)
RENAMED = Fixture(
    "page_id long, html string, n_replaced long",
    [
        (1, '<p class="foo" title="{_offer_value:offername} &amp; co">{_offer_value:offername}, {_offer_value:offername}<a href="/foo/x.js">food</a></p><script>var foo=1</script>', 3),
        (1, '<meta name="Description" content="the {_offer_value:offername}"><meta name="author" content="foo"><code>foo</code><title>{_offer_value:offername}</title>', 2),
        (None, "", 0),
    ],
)
SCRIPTS = Fixture("case_id int, code string", [(1, "let a = 1;\nfetch('/x');\n\n  fetch ('/y'); atob(a)\n//# sourceMappingURL=a.js.map"), (2, "p{}\n/*# sourceMappingURL=b.css.map */"), (3, None)])
WARNED = Fixture(
    "case_id int, label string, line int, snippet string",
    [(1, label, line, "let a = 1; fetch('/x'); fetch ('/y'); atob(a) //# sourceMappingURL=a.js.map") for label, line in (("fetch()", 2), ("fetch()", 4), ("atob()", 4))],
)
STRIPPED = Fixture("case_id int, code string", [(1, "let a = 1;\nfetch('/x');\n\n  fetch ('/y'); atob(a)\n"), (2, "p{}\n"), (3, None)])
