"""Cleaning of markup as edit planning: elements with offsets, edits by rules, the outermost edits applied.

Python only finds where elements, attributes and texts stand. Which of them go is decided by Column expressions over the
array of a page's elements, in the page's row; Python puts the chosen edits into the text. Nothing is shuffled, and rows that
share a page_id, or have none, don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import policy, urls
from pagemill.operators import extract
from pagemill.operators.markup import attribute, elements, value_of, with_elements, with_elements_or_error, with_outermost


def _edit(start: Column, stop: Column, new: Column, pass_no: int, action: Column | str, reason: str) -> Column:
    action = F.lit(action) if isinstance(action, str) else action
    return F.struct(start.alias("start"), stop.alias("stop"), new.alias("new"), F.lit(pass_no).alias("pass_no"), action.alias("action"), F.lit(reason).alias("reason"))


def judged(found: Column) -> Column:
    """The elements with what the rules ask for: src, kind of resource, action of its verdict (null where nothing is loaded)."""

    def read(e: Column) -> Column:
        tag, src, href = e["tag"], value_of(e["attrs"], "src"), value_of(e["attrs"], "href")
        kind = F.when(tag == "script", "script").when(tag.isin("iframe", "embed"), "iframe").when(tag == "img", "img").when(tag.isin("video", "audio", "source"), "media").when(tag == "link", extract.link_kind(value_of(e["attrs"], "rel"), value_of(e["attrs"], "as")))
        return F.struct(e.alias("e"), src.alias("src"), kind.alias("kind"), F.when(tag == "link", href).otherwise(src).alias("target"))

    def judge(x: Column) -> Column:
        loads = x["kind"].isNotNull() & x["target"].isNotNull()
        return F.struct(x["e"].alias("e"), x["src"].alias("src"), x["kind"].alias("kind"), F.when(loads, urls.verdict(x["target"], x["kind"])["action"]).alias("action"))

    return F.transform(F.transform(found, read), judge)


def element_edits(found: Column) -> Column:
    """Elements that go, the first rule that holds for each; `found` is an array of judged elements. A noscript goes if nothing but what goes is in it."""
    remove, hold = F.lit("remove"), F.lit("quarantine")

    def edit(x: Column) -> Column:
        e = x["e"]
        tag, body, outside = e["tag"], F.coalesce(e["body"], F.lit("")), e["within"] != "noscript"
        meta, equiv = F.lower(value_of(e["attrs"], "name")), F.lower(value_of(e["attrs"], "http-equiv"))
        foreign = F.coalesce(x["action"] != "keep", F.lit(False))
        inline = (tag == "script") & x["src"].isNull()
        ld_json = F.coalesce(F.lower(value_of(e["attrs"], "type")) == "application/ld+json", F.lit(False))
        rule = lambda n, action, reason: _edit(e["start"], e["stop"], F.lit(""), n, action, reason)
        return (
            F.when(~outside, F.when(foreign, rule(6, hold, "noscript")))
            .when(tag == "base", rule(1, remove, "base"))
            .when((tag == "script") & foreign, rule(3, x["action"], "script"))
            .when(inline & ld_json & body.rlike("(?i)googletagmanager|google-analytics|(?s)WebSite.*SearchAction"), rule(4, remove, "tracker data"))
            .when(inline & ~ld_json & (F.size(extract.keywords_in(body)) > 0), rule(5, remove, "inline tracker"))
            .when((tag == "noscript") & emptied(e, found), rule(6, hold, "noscript"))
            .when((tag == "link") & foreign, rule(8, x["action"], "link"))
            .when((tag == "meta") & meta.isin(*[m.lower() for m in policy.VERIFICATION_METAS]), rule(9, remove, "verification"))
            .when((tag == "meta") & (equiv == "refresh"), rule(10, hold, "refresh"))
            .when((tag == "iframe") & foreign, rule(11, x["action"], "iframe"))
            .when((tag == "img") & foreign, rule(12, x["action"], "img"))
            .when((tag == "object") | (tag == "embed") & foreign, rule(13, hold, "object"))
            .when(tag.isin("frame", "frameset", "noframes"), rule(14, remove, "frame"))
            .when((tag == "meta") & (equiv == "content-security-policy"), rule(19, remove, "old policy"))
        )

    return F.array_compact(F.transform(found, edit))


def emptied(e: Column, found: Column) -> Column:
    """Whether a noscript has elements that go and nothing else."""
    numbers = lambda keep: F.transform(F.filter(found, lambda x: (x["e"]["within"] == "noscript") & ((x["action"] != "keep") if not keep else ~F.coalesce(x["action"] != "keep", F.lit(False)))), lambda x: x["e"]["up"])
    return F.array_contains(numbers(False), e["number"]) & ~F.array_contains(numbers(True), e["number"]) & (F.trim(F.regexp_replace(e["body"], r"\s+", " ")) == "")


def attribute_edits(found: Column) -> Column:
    """Edits of single attributes: dangerous links lose theirs, other links and foreign macros become the offer, event handlers with addresses or trackers go, styles lose external addresses."""

    def edits(e: Column) -> Column:
        link = e["tag"].isin("a", "area")

        def edit(a: Column) -> Column:
            value, href = a["value"], link & (a["name"] == "href")
            handler = a["name"].rlike("^on[a-z]") & (value.rlike("(?i)https?://") | (F.size(extract.keywords_in(value)) > 0))
            css = extract.clean_css(value)
            quoted = F.concat(F.lit(' style="'), F.replace(F.replace(css, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
            rule = lambda n, new, action, reason: _edit(a["start"], a["stop"], new, n, action, reason)
            offer = F.lit(' href="{offer}"')
            return (
                F.when(href & urls.scheme(urls.normalized(value)).isin(*policy.DANGEROUS_SCHEMES), rule(15, F.lit(""), "quarantine", "dangerous link"))
                .when(href & value.rlike(r"^\s*\{[^}]+\}\s*$") & value.rlike(extract.FOREIGN_MACRO), rule(17, offer, "rewrite", "foreign macro"))
                .when(href & extract.becomes_offer(value), rule(16, offer, "rewrite", "offer link"))
                .when(handler, rule(18, F.lit(""), "remove", "event handler"))
                .when((a["name"] == "style") & F.contains(F.lower(value), F.lit("url")) & (css != value), rule(7, quoted, "rewrite", "style"))
            )

        return F.transform(e["attrs"], edit)

    return F.array_compact(F.flatten(F.transform(found, edits)))


#: Elements whose texts keep foreign macros.
MACRO_TEXTS = ["script", "style", "template", "textarea", "pre"]


def text_edits(found: Column) -> Column:
    """Edits of texts: styles lose external imports and addresses, texts lose foreign macros."""

    def edit(e: Column) -> Column:
        css = extract.clean_css(e["body"])
        bare = F.regexp_replace(F.regexp_replace(e["body"], extract.FOREIGN_MACRO, ""), r"[ \t]{2,}", " ")
        stop = e["inner"] + F.length(e["body"])
        return F.when((e["tag"] == "style") & (css != e["body"]), _edit(e["inner"], stop, css, 7, "rewrite", "style")).when(
            (e["tag"] == "#text") & ~e["within"].isin(*MACRO_TEXTS) & e["body"].rlike(extract.FOREIGN_MACRO), _edit(e["start"], e["stop"], bare, 17, "rewrite", "foreign macro")
        )

    return F.array_compact(F.transform(found, edit))


def policy_edit(found: Column, policy_tag: str) -> Column:
    """The policy tag behind the head's first charset, else where the head starts, else in a head of its own."""
    stop = lambda tag, more: F.array_min(F.transform(F.filter(found, lambda e: (e["tag"] == tag) & more(e)), lambda e: e["inner"]))
    charset = stop("meta", lambda e: (e["within"] == "head") & F.exists(e["attrs"], lambda a: a["name"] == "charset"))
    at = F.coalesce(charset, stop("head", lambda e: F.lit(True)))
    own = F.coalesce(stop("html", lambda e: F.lit(True)), F.lit(0))
    return _edit(F.coalesce(at, own), F.coalesce(at, own), F.when(at.isNotNull(), F.lit(policy_tag)).otherwise(F.lit(f"<head>{policy_tag}</head>")), 19, "insert", "policy")


def with_edits(pages: DataFrame, policy_tag: str = "", longest: int | None = None) -> DataFrame:
    """`pages` (page_id, html) without server code and the edits that rules ask for (markup.with_outermost() takes those that lie in no other).

    A page that can't be read ends the job, whatever its length. Only with `longest` it has no edits but an `error`, see
    markup.with_elements_or_error(); that column goes on to whoever asked for it.
    """
    stripped = pages.select("page_id", extract.strip_server_code(F.coalesce("html", F.lit(""))).alias("html"))
    rows = with_elements(stripped) if longest is None else with_elements_or_error(stripped, longest=longest)
    rows = rows.withColumn("judged", judged(F.col("elements")))
    both = [element_edits(F.col("judged")), attribute_edits(F.col("elements")), text_edits(F.col("elements"))]
    if policy_tag:
        both.append(F.when(F.exists("elements", lambda e: e["tag"] != "#text"), F.array(policy_edit(F.col("elements"), policy_tag))).otherwise(F.array().cast(EDITS)))
    return rows.select("page_id", "html", F.concat(*both).cast(EDITS).alias("edits"), *[] if longest is None else ["error"])


EDITS = "array<struct<start:int,stop:int,new:string,pass_no:int,action:string,reason:string>>"


def planned(pages: DataFrame, policy_tag: str = "") -> DataFrame:
    """page_id, start, stop, new, pass_no, action, reason: the edits of `pages`, offsets in the text without server code."""
    return with_outermost(with_edits(pages, policy_tag), None).select("page_id", F.inline("edits"))


def _unspaced() -> Column:
    return F.regexp_replace("html", r"\n{3,}", "\n\n")


def _n_edits() -> Column:
    return F.size("edits").cast("long").alias("n_edits")


def cleaned(pages: DataFrame, policy_tag: str = "") -> DataFrame:
    """page_id, html, n_edits for each row of `pages`: server code out, edits applied, `policy_tag` put into the head, blank lines collapsed. Null html is empty. Rows are cleaned one by one, whether page_ids repeat or are null. A page that can't be read ends the job: none comes back as it was."""
    return with_outermost(with_edits(pages, policy_tag)).select("page_id", _unspaced().alias("html"), _n_edits())


def cleaned_or_error(pages: DataFrame, policy_tag: str = "", longest: int = 1 << 26) -> DataFrame:
    """cleaned(), and `error` (markup.ERROR): a page that can't be read only loses its server code and is held by its error; see error_log()."""
    rows = with_outermost(with_edits(pages, policy_tag, longest))
    text = F.when(F.col("error").isNull(), _unspaced()).otherwise(F.col("html"))
    return rows.select("page_id", text.alias("html"), _n_edits(), "error")


def error_log(results: DataFrame) -> DataFrame:
    """page_id, step, kind, message: a row for each page whose result has an error."""
    return results.where("error IS NOT NULL").select("page_id", "error.*")


def by_structure(url: Column) -> Column:
    """The official address of a file that lies where a public library host has it: /ajax/libs/<name>/<version>/<rest>, or /npm/<name>@<version>/<rest> of a trusted package; null elsewhere. Only the path counts."""
    own = urls.path(url)
    at = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.lit("/"), own))
    version = r"(\d+\.\d+(?:\.\d+)?(?:[-+.][0-9A-Za-z.]+)?)"
    npm = rf"(?i)^/npm/((?:@[^/]+/)?[^/@]+)@{version}/.+\z"
    trusted = F.lower(F.regexp_extract(at, npm, 1)).isin(*policy.TRUSTED_PACKAGES)
    return F.when(at.rlike(rf"(?i)^/ajax/libs/[^/]+/{version}/.+\z"), F.concat(F.lit("https://cdnjs.cloudflare.com"), at)).when(at.rlike(npm) & trusted, F.concat(F.lit("https://cdn.jsdelivr.net"), at))


def replacements(pages: DataFrame, official: DataFrame) -> DataFrame:
    """url, cdn_url, integrity: the different addresses of scripts and links of `pages` that are a library's copy, by name or else by structure, whose official file is in `official` (cdn_url, integrity: what a look at the file found; null without a digest). Addresses that are kept anyway have none."""
    loaded = elements(pages, ("script", "link"), ("src", "href")).where("within <> 'noscript'")
    url = F.when(F.col("tag") == "script", attribute("src")).otherwise(attribute("href"))
    rows = loaded.select(url.alias("url")).where("url IS NOT NULL").distinct()
    rows = rows.where(~(urls.is_absolute(F.col("url")) & (urls.verdict(F.col("url"), F.lit("script"))["action"] == "keep")))
    rows = rows.withColumn("cdn_url", F.coalesce(extract.library(F.col("url"))["cdn_url"], by_structure(F.col("url"))))
    return rows.join(official, "cdn_url").select("url", "cdn_url", "integrity")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables of replacements; where both have an address the second's counts."""
    both = first.withColumn("place", F.lit(0)).unionByName(second.withColumn("place", F.lit(1)))
    return both.groupBy("url").agg(F.max_by(F.struct("cdn_url", "integrity"), "place").alias("x")).select("url", "x.*")


def pinned(pages: DataFrame, replaced: DataFrame) -> DataFrame:
    """page_id, html, changes (array of url, cdn_url, integrity) for each row of `pages`: scripts and links that load an address in `replaced` (url, cdn_url, integrity; one row for each url) load the official file, with its digest where there is one.

    Addresses leave their pages as rows, meet `replaced` by url (a join that splits hot urls), and come back as one map for
    each page. Pages without any stay as they are; null html is empty.
    """
    keyed = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).withColumn("row", F.xxhash64("page_id", "html"))
    opened = with_elements(keyed, ("script", "link"), ("src", "href", "integrity", "crossorigin"))
    url_of = lambda e: F.when(e["tag"] == "script", value_of(e["attrs"], "src")).otherwise(value_of(e["attrs"], "href"))
    there = F.array_distinct(F.array_compact(F.transform(F.filter("elements", lambda e: e["within"] != "noscript"), url_of)))
    hits = opened.select("row", F.explode(there).alias("url")).distinct().join(replaced, "url")
    maps = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("url", F.struct("cdn_url", "integrity")))).alias("map"))
    joined = opened.join(maps, "row", "left")
    quoted = lambda name, v: F.concat(F.lit(f' {name}="'), F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))

    def edits(e: Column) -> Column:
        new = F.try_element_at(F.col("map"), url_of(e))
        name = F.when(e["tag"] == "script", "src").otherwise("href")
        digest = F.coalesce(F.concat(quoted("integrity", new["integrity"]), F.lit(' crossorigin="anonymous"')), F.lit(""))
        address = F.when(e["tag"] == "script", quoted("src", new["cdn_url"])).otherwise(quoted("href", new["cdn_url"]))
        old = F.filter(e["attrs"], lambda a: new["integrity"].isNotNull() & a["name"].isin("integrity", "crossorigin") | (a["name"] == name))
        first = F.try_element_at(F.filter(e["attrs"], lambda a: a["name"] == name), F.lit(1))["start"]
        cut = F.transform(old, lambda a: F.struct(a["start"].alias("start"), a["stop"].alias("stop"), F.when(a["start"] == first, F.concat(address, digest)).otherwise(F.lit("")).alias("new")))
        return F.when(new.isNotNull() & (e["within"] != "noscript"), cut)

    changes = F.transform(F.array_compact(F.transform(F.array_distinct(F.array_compact(F.transform(F.filter("elements", lambda e: e["within"] != "noscript"), url_of))), lambda u: F.when(F.try_element_at(F.col("map"), u).isNotNull(), u))), lambda u: F.struct(u.alias("url"), F.try_element_at(F.col("map"), u)["cdn_url"].alias("cdn_url"), F.try_element_at(F.col("map"), u)["integrity"].alias("integrity")))
    planned = joined.select("page_id", "html", F.flatten(F.array_compact(F.transform("elements", edits))).cast("array<struct<start:int,stop:int,new:string>>").alias("edits"), F.coalesce(changes, F.array().cast("array<struct<url:string,cdn_url:string,integrity:string>>")).alias("changes"))
    return with_outermost(planned).select("page_id", "html", "changes")


def held(pages: DataFrame, policy_tag: str = "", kept: int = 2000, told: int = 300) -> DataFrame:
    """page_id, number (from 1, by place in the page), reason, snippet (the first `kept` characters of what was taken out), shown (its first `told`): what cleaning holds for review of each row of `pages`, so that it can be put back. Rows with one page_id are told apart by their text alone."""
    rows = with_outermost(with_edits(pages, policy_tag), None)
    cut = F.transform(F.filter("edits", lambda e: e["action"] == "quarantine"), lambda e: F.struct(e["reason"].alias("reason"), F.substring("html", e["start"] + 1, F.least(e["stop"] - e["start"], F.lit(kept))).alias("snippet")))
    found = rows.select("page_id", F.posexplode(cut).alias("at", "x"))
    return found.select("page_id", (F.col("at") + 1).alias("number"), "x.reason", "x.snippet", F.substring("x.snippet", 1, told).alias("shown"))


def macro_flags(pages: DataFrame) -> DataFrame:
    """page_id, kind (own, link, image, text, script, other), token, element, attr: every macro of `pages`, what becomes of it or who has to look at it. Foreign macros of one place are one row."""
    rows = elements(pages)
    scanned = ["href", "src", "srcset", "poster", "content", "action", "formaction"]
    url_tokens = lambda text: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)url\([^)]*\)"), F.lit(0)), tokens))

    def tokens(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(policy.MACRO), F.lit(0))

    attrs = rows.select("page_id", F.col("tag").alias("element"), F.explode("attrs").alias("a")).select("page_id", "element", F.col("a.name").alias("attr"), F.col("a.value").alias("value"))
    styles = attrs.where("attr = 'style'").select("page_id", "element", "attr", url_tokens(F.col("value")).alias("found"), F.lit("image").alias("kind"))
    link = F.col("element").isin("a", "area") & (F.col("attr") == "href") & F.col("value").rlike(r"^\s*\{[^}]+\}\s*$")
    image = F.col("attr").isin("src", "srcset", "poster", "data-src")
    others = attrs.where(F.col("attr").isin(*scanned) | F.col("attr").startswith("data-")).select("page_id", "element", "attr", tokens(F.col("value")).alias("found"), F.when(link, "link").when(image, "image").otherwise("other").alias("kind"))
    texts = rows.where(~F.col("within").isin(*MACRO_TEXTS) & (F.col("tag") == "#text")).select("page_id", F.concat(F.lit("text<"), "within", F.lit(">")).alias("element"), F.lit("(text)").alias("attr"), tokens(F.col("body")).alias("found"), F.lit("text").alias("kind"))
    inline = rows.where((F.col("tag") == "script") & attribute("src").isNull() & ~F.coalesce(F.lower(attribute("type")).contains("json"), F.lit(False)))
    code = inline.select("page_id", F.lit("script").alias("element"), F.lit("(js-string)").alias("attr"), F.array_distinct(F.flatten(F.transform(extract.literals(F.col("body")), tokens))).alias("found"), F.lit("script").alias("kind"))
    sheets = rows.where("tag = 'style'").select("page_id", F.lit("style").alias("element"), F.lit("(css-url)").alias("attr"), url_tokens(F.col("body")).alias("found"), F.lit("image").alias("kind"))
    whole = styles.unionByName(others).unionByName(texts).unionByName(code).unionByName(sheets).where(F.size("found") > 0)
    is_own = lambda t: t.isin(*policy.OWN_MACROS)
    own = F.transform(F.filter("found", is_own), lambda t: F.struct(F.lit("own").alias("kind"), t.alias("token")))
    foreign = F.filter("found", lambda t: ~is_own(t))
    joined = F.array_join(F.when(F.col("kind") == "image", F.when(F.col("attr").isin("style", "(css-url)"), F.array_distinct(foreign)).otherwise(foreign)).otherwise(foreign), " ")
    found = F.concat(own, F.when(F.size(foreign) > 0, F.array(F.struct(F.col("kind"), joined.alias("token")))).otherwise(F.array().cast("array<struct<kind:string,token:string>>")))
    return whole.select("page_id", "element", "attr", F.inline(found)).select("page_id", "kind", "token", "element", "attr")
