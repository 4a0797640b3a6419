"""Rows out of markup, style sheets and scripts: elements from markup.elements(), the rest by built-in regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import policy, urls
from pagemill.operators import markup

def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), group)


def mapped(text: Column, pattern: str, new) -> Column:
    """The text with each match m of the pattern replaced by new(m), all at once: no replacement is looked at again."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.transform(hits, new), lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


#: Elements with an address.
LOADING = ("script", "iframe", "img", "video", "audio", "source", "link", "a", "area")


def resources(pages: DataFrame) -> DataFrame:
    """page_id, kind, url: a row for every resource of a page, repeats included, whatever its quotes; none from comments, scripts or noscripts."""
    found = markup.elements(pages, LOADING, ("src", "href"), bare=False).where("within <> 'noscript'")
    tag = F.col("tag")
    kind = F.when(tag.isin("script", "iframe", "img"), tag).when(tag.isin("video", "audio", "source"), "media").when(tag == "link", "stylesheet").when(tag.isin("a", "area"), "anchor")
    url = F.when(tag.isin("link", "a", "area"), markup.attribute("href")).otherwise(markup.attribute("src"))
    return found.select("page_id", kind.alias("kind"), url.alias("url")).where("kind IS NOT NULL AND url IS NOT NULL")


def classified(pages: DataFrame) -> DataFrame:
    """The resources with action, reason and host: one scan, no shuffle."""
    return urls.with_verdict(resources(pages), "url", "kind")


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, href of every link."""
    found = markup.elements(pages, ("a", "area"), ("href",), bare=False).where("within <> 'noscript'")
    return found.select("page_id", markup.attribute("href").alias("href")).where("href IS NOT NULL")


def becomes_offer(href: Column) -> Column:
    """Whether a link is turned into the offer macro: all but fragments, mail, phone, pure macros and empty ones."""
    h = F.trim(href)
    return (h != "") & ~h.rlike(r"(?i)^(#|mailto:|tel:)") & ~h.rlike(rf"^{policy.MACRO}\z")


#: A macro that isn't one of the own ones.
FOREIGN_MACRO = "(?!" + "|".join(re.escape(m) for m in policy.OWN_MACROS) + ")" + policy.MACRO


def inline_scripts(pages: DataFrame, executable: bool = False) -> DataFrame:
    """The columns of `pages` but html, number and body, of every script element without src, those in comments or a noscript left out; with `executable` only those whose type browsers run."""
    found = markup.with_elements(pages, ("script",), ("src", "type"))
    rows = found.select(*[c for c in pages.columns if c != "html"], F.inline("elements"))
    rows = rows.where((F.col("within") != "noscript") & markup.attribute("src").isNull())
    if executable:
        rows = rows.where(runs(markup.attribute("type")))
    return rows.select(*[c for c in pages.columns if c != "html"], "number", "body").where("body IS NOT NULL")


def runs(kind: Column) -> Column:
    """Whether browsers run a script of that type: none, an empty one, a module or a type of JavaScript (parameters don't matter)."""
    plain = F.lower(F.trim(F.regexp_extract(F.coalesce(kind, F.lit("")), r"^([^;]*)", 1)))
    return plain.isin("", "module") | plain.rlike(policy.JAVASCRIPT_TYPE)


def keywords_in(body: Column) -> Column:
    """The tracker keywords that a script holds, in the order of the list."""
    return F.filter(F.array(*map(F.lit, policy.INLINE_KEYWORDS)), lambda k: F.contains(body, k))


def text_only(html: Column) -> Column:
    """The markup without its script and style elements."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")


def macros(pages: DataFrame) -> DataFrame:
    """page_id, token, own, n: macro tokens outside scripts and styles."""
    tokens = pages.select("page_id", F.explode(all_of(text_only(F.coalesce("html", F.lit(""))), policy.MACRO, 0)).alias("token"))
    return tokens.groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("n")).select("page_id", "token", F.col("token").isin(*policy.OWN_MACROS).alias("own"), "n")


def css_urls(css: Column) -> Column:
    """Targets of url(...) and @import in a style sheet, data: left out."""
    named = F.concat(all_of(css, r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"), all_of(css, r"(?i)@import\s+['\"]([^'\"]+)['\"]"))
    return F.filter(named, lambda u: ~u.rlike("(?i)^data:"))


_IMPORT = r"""(?i)@import\s+(?:url\(\s*(?:"([^"]*)"|'([^']*)'|([^)'"\s]*))\s*\)|"([^"]*)"|'([^']*)')[^;]*;?"""
_CSS_URL = r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)"


def clean_css(css: Column) -> Column:
    """A style sheet whose imports from hosts that libraries don't come from are gone, and whose url() targets that aren't kept are empty; protocol-relative addresses count as external. A semicolon in an address doesn't end its import."""

    def external(m: Column) -> Column:
        u = urls.normalized(F.concat(*[F.regexp_extract(m, _IMPORT, i) for i in range(1, 6)]))
        return urls.is_absolute(u) & ~urls.in_domains(urls.host(u), policy.TRUSTED_LIB_HOSTS)

    imports = F.array_distinct(F.filter(all_of(css, _IMPORT, 0), external))
    rest = F.aggregate(imports, css, lambda text, m: F.replace(text, m, F.lit("")))
    bad = lambda text: F.array_distinct(F.filter(all_of(text, _CSS_URL, 0), lambda m: urls.verdict(F.regexp_extract(m, _CSS_URL, 1), F.lit("img"))["action"] != "keep"))
    return F.when(~F.contains(F.lower(css), F.lit("url")) & ~F.contains(css, F.lit("@")), css).otherwise(F.aggregate(F.flatten(F.transform(F.array(rest), bad)), rest, lambda text, m: F.replace(text, m, F.lit("url('')"))))


def has_server_code(text: Column) -> Column:
    return text.rlike(r"(?is)<\?php|<\?=|<\?(?:[^x]|x[^m])[^>]*\?>|<%.*?%>")


def strip_server_code(text: Column) -> Column:
    """Closed blocks of <? ?> (but for <?xml ?>) and <% %>, and PHP that runs to the end, taken out."""
    closed = F.regexp_replace(text, r"(?is)<\?(?:php|=).*?\?>", "")
    short = F.regexp_replace(closed, r"(?is)<\?(?:[^xp=]|x[^m]|p[^h]).*?\?>", "")
    asp = F.regexp_replace(short, r"(?is)<%.*?%>", "")
    return F.regexp_replace(asp, r"(?is)<\?(?:php|=).*", "")


def labelled(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Array of (label, n) of the patterns that the text has."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_count(text, F.lit(p)).cast("long").alias("n")) for label, p in patterns])
    return F.filter(counts, lambda c: c["n"] > 0)


def obfuscation(code: Column) -> Column:
    """STRUCT<ids, hex_ids, obfuscated>: more than 15 of 100 identifiers like _0x1a, a packer, or String['fromCharCode']."""
    ids, hexes = F.regexp_count(code, F.lit(r"[A-Za-z_$][\w$]*")).cast("long"), F.regexp_count(code, F.lit(r"_0x[0-9a-fA-F]+")).cast("long")
    odd = (hexes * 100 > ids * 15) | code.rlike(r"eval\(function\(p,a,c,k,e") | code.rlike(r"String\[['\"]fromCharCode['\"]\]")
    return F.struct(ids.alias("ids"), hexes.alias("hex_ids"), odd.alias("obfuscated"))


def svg_cleaned(svg: Column) -> Column:
    """An SVG without scripts, foreign objects, handlers (quoted or not), external or dangerous references, and external addresses in its styles."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<script\b[^>]*/>", r"(?is)<foreignObject\b.*?</foreignObject>", r"""(?i)\s+on\w+\s*=\s*(?:'[^']*'|"[^"]*"|[^\s>]+)"""):
        svg = F.regexp_replace(svg, pattern, "")
    reference = r"""(?i)\s(?:xlink:)?href\s*=\s*(?:"([^"]+)"|'([^']+)')"""

    def bad(m: Column) -> Column:
        u = urls.normalized(F.concat(F.regexp_extract(m, reference, 1), F.regexp_extract(m, reference, 2)))
        return F.coalesce(urls.scheme(u).isin(*policy.DANGEROUS_SCHEMES), F.lit(False)) | urls.is_absolute(u) & ~urls.in_domains(urls.host(u), policy.TRUSTED_LIB_HOSTS)

    svg = F.aggregate(F.array_distinct(F.filter(all_of(svg, reference, 0), bad)), svg, lambda text, m: F.replace(text, m, F.lit("")))
    styles = F.array_distinct(all_of(svg, r"(?is)<style\b[^>]*>.*?</style>", 0))
    return F.aggregate(styles, svg, lambda text, m: F.replace(text, m, clean_css(m)))


def link_kind(rel: Column, as_attr: Column) -> Column:
    """Kind of resource of a link element, null where nothing is loaded that counts."""
    rels = F.split(F.lower(F.trim(rel)), r"\s+")
    has = lambda name: F.array_contains(rels, name)
    loaded = F.when(as_attr == "script", "script").when(as_attr.isin("style", "font"), "stylesheet").when(as_attr == "image", "img").when(as_attr.isin("video", "audio", "track"), "media").when(as_attr.isin("document", "iframe"), "iframe").otherwise("script")
    return F.when(has("stylesheet"), "stylesheet").when(has("modulepreload"), "script").when(has("preload") | has("prefetch"), loaded).when(has("preconnect") | has("dns-prefetch"), "preconnect")


def library(url: Column) -> Column:
    """STRUCT<lib, version, cdn_url>: the first library whose file name matches, if the URL has a version; else null."""
    version = F.nullif(F.regexp_extract(url, r"[@/\-](\d+\.\d+(?:\.\d+)?)(?:[/.\-]|\z)", 1), F.lit(""))
    out = F.lit(None).cast("struct<lib:string,version:string,cdn_url:string>")
    for name, pattern, target in reversed(policy.LIBRARIES):
        there = F.struct(F.lit(name).alias("lib"), version.alias("version"), F.replace(F.lit(target), F.lit("{v}"), version).alias("cdn_url"))
        out = F.when(urls.basename(url).rlike(pattern) & version.isNotNull(), there).otherwise(out)
    return out


def library_by_code(code: Column) -> Column:
    """STRUCT<lib, version, cdn_url>: the first library whose signature the code has; null without one."""
    out = F.lit(None).cast("struct<lib:string,version:string,cdn_url:string>")
    for name, signature, version, default, target in reversed(policy.LIBRARY_CODE):
        found = F.concat(F.regexp_extract(code, version, 1), F.regexp_extract(code, version, 2))
        v = F.when(found == "", F.lit(default)).otherwise(found)
        out = F.when(code.rlike(signature), F.struct(F.lit(name).alias("lib"), v.alias("version"), F.replace(F.lit(target), F.lit("{v}"), v).alias("cdn_url"))).otherwise(out)
    return out


def without_source_maps(code: Column) -> Column:
    """Script or style code without the comments that name its source map."""
    return F.regexp_replace(F.regexp_replace(code, r"//[#@][ \t]*sourceMappingURL\s*=\s*\S+", ""), r"/\*#[ \t]*sourceMappingURL\s*=\s*[^*]*\*/", "")


def external_folder(host: Column) -> Column:
    """What becomes of the saved folder _external/<host>: keep, remove or quarantine, as a script from that host's root would."""
    return urls.verdict(F.concat(F.lit("https://"), F.lower(host), F.lit("/")), F.lit("script"))["action"]


def code_warnings(rows: DataFrame) -> DataFrame:
    """label, line, snippet beside the other columns of `rows` (code, and others): a row for each suspicious place of the code, with 150 characters around it in one line."""

    def places(label: str, pattern: str) -> Column:
        parts = F.split(F.col("code"), pattern)
        hits = F.regexp_extract_all("code", F.lit(pattern), F.lit(0))

        def place(hit: Column, i: Column) -> Column:
            before = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(parts, 1, i), F.slice(hits, 1, i), lambda a, b: F.array(a, b))), ""), F.element_at(parts, i + 1))
            around = F.concat(F.right(before, F.lit(150)), hit, F.substring(F.col("code"), F.length(before) + F.length(hit) + 1, F.lit(150)))
            return F.struct(F.lit(label).alias("label"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), F.trim(F.regexp_replace(around, r"\s+", " ")).alias("snippet"))

        return F.transform(hits, place)

    found = F.concat(*[F.when(F.col("code").rlike(p), places(label, p)).otherwise(F.array().cast("array<struct<label:string,line:int,snippet:string>>")) for label, p in policy.JS_WARNINGS])
    return rows.select(*[c for c in rows.columns if c != "code"], F.inline(found))


def is_offer(url: Column, main_host: Column) -> Column:
    """Whether a URL leads to an offer: another host that isn't trusted, or a telling path or query on the own host."""
    u = F.regexp_replace(url, "(?i)&amp;", "&")
    h = urls.host(u)
    own = F.coalesce(F.array_contains(urls.domains(h), main_host), F.lit(False))
    info = urls.path(u).rlike(r"(?i)^/(" + "|".join(policy.INFO_PATHS) + r")(/|\z)") | urls.path(u).rlike(r"(?i)^/wp-(content|admin|includes|json)/")
    telling = u.rlike("(?i)[?&](" + "|".join(policy.OFFER_PARAMETERS) + ")") | u.rlike("(?i)/(" + "|".join(policy.OFFER_PATHS) + ")/")
    return urls.is_absolute(u) & h.isNotNull() & F.when(own, ~info & telling).otherwise(~urls.in_domains(h, policy.TRUSTED_LIB_HOSTS + policy.OWN_ASSET_HOSTS))


def suspicious(code: Column) -> Column:
    """Whether a script has a sign of sending, loading or leading away; null has none."""
    return F.coalesce(code.rlike(policy.SUSPICIOUS), F.lit(False))


def _by_map(known: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), key)


def file_category(rel_path: Column) -> Column:
    """Category of a file by its extension: html, css, js, image, font, media or other."""
    known = {e: c for c, exts in policy.FILE_CATEGORIES.items() for e in exts}
    return F.coalesce(_by_map(known, urls.extension(rel_path)), F.lit("other"))


def request_category(kind: Column) -> Column:
    """Category of a response by the kind of its request; an unknown kind is its own category, none is other."""
    return F.coalesce(_by_map(policy.REQUEST_CATEGORIES, kind), F.nullif(kind, F.lit("")), F.lit("other"))


#: A string or template of a script.
LITERAL = r"""\x22(?:[^\x22\\\n]|\\.)*\x22|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""


def literals(code: Column) -> Column:
    """The strings and templates of a script, what templates put in left out."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(LITERAL), F.lit(0))
    return F.transform(found, lambda x: F.when(x.startswith("`"), F.regexp_replace(x, r"\$\{[^}]*\}", " ")).otherwise(x))


def file_macros(files: DataFrame) -> DataFrame:
    """The columns of `files` (rel_path, content and others) but content, and kind, token, element, attr: macros of script files, in strings alone, and of style sheets, in url() alone.

    Each own macro is a row: once in a script, as often as it is there in a style sheet. A file's foreign macros are one row, each
    once, in the order in which they come: script (somebody has to look) or image (adaptation fills it in). Other files, and null content, have none.
    """
    tokens = lambda text: F.regexp_extract_all(text, F.lit(policy.MACRO), F.lit(0))
    script, style = F.col("rel_path").rlike(r"(?i)\.m?js\z"), F.col("rel_path").rlike(r"(?i)\.css\z")
    others = [c for c in files.columns if c != "content"]
    found = files.where((script | style) & F.contains("content", F.lit("{")))
    found = found.select(*others, script.alias("_script"), F.when(script, F.array_distinct(F.flatten(F.transform(literals(F.col("content")), tokens)))).otherwise(F.flatten(F.transform(all_of(F.col("content"), r"(?i)url\([^)]*\)", 0), tokens))).alias("_found"))
    is_own = lambda t: t.isin(*policy.OWN_MACROS)
    own = F.transform(F.filter("_found", is_own), lambda t: F.struct(F.lit("own").alias("kind"), t.alias("token")))
    foreign = F.array_distinct(F.filter("_found", lambda t: ~is_own(t)))
    joined = F.when(F.size(foreign) > 0, F.array(F.struct(F.when(F.col("_script"), "script").otherwise("image").alias("kind"), F.array_join(foreign, " ").alias("token"))))
    rows = found.select(*others, "_script", F.inline(F.concat(own, F.coalesce(joined, F.array().cast("array<struct<kind:string,token:string>>")))))
    return rows.select(*others, "kind", "token", F.when(F.col("_script"), "script(external)").otherwise("style(external)").alias("element"), F.when(F.col("_script"), "(js-string)").otherwise("(css-url)").alias("attr"))


def unmapped(files: DataFrame) -> DataFrame:
    """`files` (rel_path, content and others) with the column outcome: source maps are deleted (their content is null), script and style files stripped of the comments that name one, all others kept. Null content is kept."""
    code = F.col("rel_path").rlike(r"(?i)\.(m?js|css)\z")
    plain = F.when(code, without_source_maps(F.col("content"))).otherwise(F.col("content"))
    is_map = F.coalesce(F.col("rel_path").rlike(r"(?i)\.map\z"), F.lit(False))
    outcome = F.when(is_map, "deleted").when(plain != F.col("content"), "stripped").otherwise("kept")
    return files.withColumns({"outcome": outcome, "content": F.when(~is_map, plain)})
