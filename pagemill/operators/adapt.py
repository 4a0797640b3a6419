"""Adaptation to an offer: configuration layers, image target, product names and images."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import policy
from pagemill.operators import extract, markup

#: Image bases by vertical; placeholders, to be set by whoever runs the engine.
IMAGE_BASES = {"Adult": "https://assets.example.com/Adult/{_offer_value:offerimage}", "WeightLoss": "https://assets.example.com/WeightLoss/{_offer_value:offerimage}"}
NAME_MACRO = "{_offer_value:offername}"


def layered(config: DataFrame) -> DataFrame:
    """One row: each setting from the highest layer that has it."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("layer"))).alias(c)
    return config.agg(last("default_vertical"), last("name_macro"))


def image_target(vertical: Column, mode: Column, file: Column, default: str = "Adult") -> Column:
    """Where product images point: nowhere if skipped, to a file, or to the vertical's base."""
    bases = F.create_map(*[F.lit(x) for pair in IMAGE_BASES.items() for x in pair])
    chosen = F.trim(F.coalesce(vertical, F.lit(default)))
    return F.when(mode == "skip", F.lit(None)).when(mode == "file", file).otherwise(F.try_element_at(bases, chosen))


def names_pattern(names: list[str]) -> str:
    """Any of the names as whole words, longest first, any white space between words."""
    ordered = sorted({n for n in names if n.strip()}, key=lambda n: (-len(n), n))
    return "(?i)(?<![\\p{L}\\p{N}_])(?:" + "|".join(r"\s+".join(map(re.escape, n.split())) for n in ordered) + ")(?![\\p{L}\\p{N}_])"


def renamed(text: Column, names: list[str], macro: str = NAME_MACRO) -> Column:
    return F.regexp_replace(text, names_pattern(names), macro.replace("\\", "\\\\").replace("$", "\\$"))


def names_replaced(pages: DataFrame, names: list[str], macro: str = NAME_MACRO) -> DataFrame:
    """`pages` with html and n_replaced: product names become the macro where they are shown, in texts (but for code), four attributes and the descriptions of metas. Markup, addresses and scripts stay. Null html is empty."""
    others = [c for c in pages.columns if c != "html"]
    rows = markup.with_elements(pages.select(*others, F.coalesce("html", F.lit("")).alias("html")))
    pattern = F.lit(names_pattern(names))
    struct = lambda start, stop, new, n: F.struct(start.alias("start"), stop.alias("stop"), new.alias("new"), n.alias("n"))

    def in_text(e: Column) -> Column:
        n = F.regexp_count(e["body"], pattern)
        return F.when((e["tag"] == "#text") & ~e["within"].isin(*policy.NAME_SKIPPED) & (n > 0), struct(e["start"], e["stop"], renamed(e["body"], names, macro), n))

    def in_attributes(e: Column) -> Column:
        shown = (e["tag"] == "meta") & F.coalesce(F.lower(F.coalesce(markup.value_of(e["attrs"], "name"), markup.value_of(e["attrs"], "property"))).isin(*policy.NAME_METAS), F.lit(False))

        def edit(a: Column) -> Column:
            n = F.regexp_count(a["value"], pattern)
            new = F.replace(F.replace(renamed(a["value"], names, macro), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
            return F.when((a["name"].isin(*policy.NAME_ATTRIBUTES) | shown & (a["name"] == "content")) & (n > 0), struct(a["start"], a["stop"], F.concat(F.lit(" "), a["name"], F.lit('="'), new, F.lit('"')), n))

        return F.transform(e["attrs"], edit)

    edits = F.array_compact(F.concat(F.transform("elements", in_text), F.flatten(F.transform("elements", in_attributes))))
    done = markup.with_outermost(rows.select(*others, "html", edits.cast("array<struct<start:int,stop:int,new:string,n:int>>").alias("edits")))
    return done.select(*others, "html", F.aggregate("edits", F.lit(0), lambda acc, e: acc + e["n"]).cast("long").alias("n_replaced"))


# --------------------------------------------------------------------- images

CHANGE = "struct<element:string,attr:string,before:string,trigger:string>"
_STYLE_URL = r"""(?i)url\(\s*(['"]?)([^)'"]*)\1\s*\)"""


def _number(text: Column) -> Column:
    """The whole number at a text's start, as lenient readers take it; null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d{1,9})", 1), F.lit("")).cast("int")


def shows_no_product(attrs: Column) -> Column:
    """Whether an image is a vector graphic, tiny, or a logo, icon or payment sign by its names."""
    value = lambda n: markup.value_of(attrs, n)
    src = F.coalesce(value("src"), value("data-src"), F.lit(""))
    names = F.concat_ws(" ", src, value("class"), value("id"), value("alt"))
    tiny = lambda n: F.coalesce(_number(value(n)).between(1, policy.TINY_PIXELS), F.lit(False))
    return src.rlike(r"(?i)\.svg([?#]|\z)") | names.rlike(policy.NO_PRODUCT) | tiny("width") | tiny("height")


def images_replaced(pages: DataFrame, target: str, own: list[str] | None = None) -> DataFrame:
    """page_id, html, changes (array of CHANGE) for each row of `pages`: images of the product become `target`.

    These are the images in links to the offer that show a product, images and sources whose addresses have a foreign
    macro or are another base of `own` (by default all of IMAGE_BASES), and such addresses in style attributes. An image
    loses the attributes that would outdo its src, a picture with a replaced image its sources; a source whose picture has
    an image is replaced through the picture's first. What already is the target stays, so a second run changes nothing.
    Links are found as intervals around an image, pictures by the number of the element around it, in the page's row.
    Elements in a noscript stay. Null html is empty.
    """
    bases = F.array(*[F.lit(b) for b in (list(IMAGE_BASES.values()) if own is None else own)]).cast("array<string>")
    goal = F.lit(target)
    attribute = F.replace(F.replace(goal, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    wanted = [*policy.IMAGE_ATTRIBUTES, *policy.RESPONSIVE_ATTRIBUTES, "href", "class", "id", "alt", "width", "height", "style"]
    rows = markup.with_elements(pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")), names=wanted)

    def asks(value: Column) -> Column:
        return F.coalesce((value != "") & (value != goal) & (value.rlike(extract.FOREIGN_MACRO) | F.array_contains(bases, value)), F.lit(False))

    def trigger(value: Column, suffix: str = "") -> Column:
        return F.when(value.rlike(extract.FOREIGN_MACRO), F.lit("foreign-macro" + suffix)).when(value.isNotNull(), F.lit("re-point" + suffix))

    def read(e: Column) -> Column:
        values = F.array(*[markup.value_of(e["attrs"], n) for n in policy.IMAGE_ATTRIBUTES])
        return F.struct(e.alias("e"), trigger(F.try_element_at(F.filter(values, asks), F.lit(1))).alias("hit"))

    of = lambda *tags: F.filter("elements", lambda e: e["tag"].isin(*tags) & (e["within"] != "noscript"))
    offers = F.filter(of("a"), lambda e: F.coalesce(markup.value_of(e["attrs"], "href") == "{offer}", F.lit(False)))
    rows = rows.withColumns({"offers": F.transform(offers, lambda e: F.struct(e["start"], e["stop"])), "imgs": F.transform(of("img"), read), "sources": F.transform(of("source"), read)})
    # each picture's first image
    firsts = F.filter("imgs", lambda x: (x["e"]["within"] == "picture") & ~F.exists("imgs", lambda y: (y["e"]["up"] == x["e"]["up"]) & (y["e"]["number"] < x["e"]["number"])))
    rows = rows.withColumn("shown", F.transform(firsts, lambda x: x["e"]["up"])).withColumn("first", F.transform(firsts, lambda x: x["e"]["number"]))

    def judge(x: Column) -> Column:
        e = x["e"]
        mine = F.filter("sources", lambda s: (s["e"]["up"] == e["up"]) & s["hit"].isNotNull() & (e["within"] == "picture") & F.array_contains("first", e["number"]))
        hits = F.array_sort(F.transform(F.concat(mine, F.when(x["hit"].isNotNull(), F.array(x)).otherwise(F.slice(mine, 1, 0))), lambda s: F.struct(s["e"]["number"], s["hit"])))
        offered = F.exists("offers", lambda a: (a["start"] < e["start"]) & (e["stop"] <= a["stop"])) & ~shows_no_product(e["attrs"])
        why = F.when(offered, F.lit("offer-anchor")).otherwise(F.try_element_at(hits, F.lit(1))["hit"])
        return F.struct(e.alias("e"), F.when(F.coalesce(markup.value_of(e["attrs"], "src"), F.lit("")) != goal, why).alias("why"))

    rows = rows.withColumn("taken", F.filter(F.transform("imgs", judge), lambda x: x["why"].isNotNull()))
    lone = F.filter("sources", lambda s: s["hit"].isNotNull() & ~((s["e"]["within"] == "picture") & F.array_contains("shown", s["e"]["up"])) & (F.coalesce(markup.value_of(s["e"]["attrs"], "srcset"), F.lit("")) != goal))
    rows = rows.withColumn("lone", lone)
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), new.alias("new"))

    def pointed(e: Column, name: str, gone: list[str]) -> Column:
        """Edits that give an element the target in one attribute and take others from it."""
        there = F.exists(e["attrs"], lambda a: a["name"] == name)
        behind = e["start"] + F.length(e["tag"]) + 1
        new = F.concat(F.lit(f' {name}="'), attribute, F.lit('"'))
        cut = F.transform(F.filter(e["attrs"], lambda a: a["name"].isin(name, *gone)), lambda a: edit(a["start"], a["stop"], F.when(a["name"] == name, new).otherwise(F.lit(""))))
        return F.concat(cut, F.when(there, F.slice(cut, 1, 0)).otherwise(F.array(edit(behind, behind, new))))

    def collapsed(x: Column) -> Column:
        gone = F.filter("sources", lambda s: (x["e"]["within"] == "picture") & (s["e"]["up"] == x["e"]["up"]))
        return F.transform(gone, lambda s: edit(s["e"]["start"], s["e"]["stop"], F.lit("")))

    def styled(e: Column) -> Column:
        value = markup.value_of(e["attrs"], "style")
        inner = lambda m: F.regexp_extract(m, _STYLE_URL, 2)
        return F.struct(e.alias("e"), value.alias("style"), F.filter(F.transform(F.regexp_extract_all(value, F.lit(_STYLE_URL), F.lit(0)), inner), asks).alias("hits"))

    style = F.filter(F.transform(F.filter("elements", lambda e: (e["within"] != "noscript") & F.coalesce(F.contains(markup.value_of(e["attrs"], "style"), F.lit("url(")), F.lit(False))), styled), lambda x: F.size(x["hits"]) > 0)
    rows = rows.withColumn("styles", style)

    def restyled(x: Column) -> Column:
        new = extract.mapped(x["style"], _STYLE_URL, lambda m: F.when(asks(F.regexp_extract(m, _STYLE_URL, 2)), F.concat(F.lit("url('"), goal, F.lit("')"))).otherwise(m))
        quoted = F.concat(F.lit(' style="'), F.replace(F.replace(new, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
        return F.transform(F.slice(F.filter(x["e"]["attrs"], lambda a: a["name"] == "style"), 1, 1), lambda a: edit(a["start"], a["stop"], quoted))

    edits = F.concat(*[F.flatten(F.transform(c, f)) for c, f in (("taken", lambda x: pointed(x["e"], "src", policy.RESPONSIVE_ATTRIBUTES)), ("taken", collapsed), ("lone", lambda s: pointed(s["e"], "srcset", ["src", *policy.RESPONSIVE_ATTRIBUTES])), ("styles", restyled))])
    change = lambda element, attr, before, why: F.struct(F.lit(element) if isinstance(element, str) else element, F.lit(attr), before, why)
    first_of = lambda e, *names: F.coalesce(*[F.nullif(markup.value_of(e["attrs"], n), F.lit("")) for n in names], F.lit(""))
    changes = F.concat(
        F.transform("taken", lambda x: change("img", "src", first_of(x["e"], "src", "data-src", "srcset"), x["why"]).cast(CHANGE)),
        F.transform("lone", lambda s: change("source", "srcset", first_of(s["e"], "srcset", "data-srcset", "src"), s["hit"]).cast(CHANGE)),
        F.flatten(F.transform("styles", lambda x: F.transform(x["hits"], lambda h: change(x["e"]["tag"], "style", h, trigger(h, "-bg")).cast(CHANGE)))),
    )
    planned = rows.select("page_id", "html", edits.cast("array<struct<start:int,stop:int,new:string>>").alias("edits"), changes.alias("changes"))
    return markup.with_outermost(planned).select("page_id", "html", "changes")


def adapted(pages: DataFrame, target: str | None, names: list[str], macro: str = NAME_MACRO) -> DataFrame:
    """page_id, changes, html, n_replaced for each row of `pages`: product images become `target` (none are changed without one), then product names the macro; see images_replaced() and names_replaced()."""
    plain = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"), F.array().cast(f"array<{CHANGE}>").alias("changes"))
    first = images_replaced(pages, target) if target else plain
    return names_replaced(first, names, macro) if any(n.strip() for n in names) else first.withColumn("n_replaced", F.lit(0).cast("long"))


def adapt_report(done: DataFrame) -> DataFrame:
    """part (image or name), element, attr, trigger, n, n_pages: what adapted() changed, in sum."""
    images = done.select("page_id", F.inline("changes")).groupBy("element", "attr", "trigger").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))
    none = F.lit(None).cast("string")
    names = done.where("n_replaced > 0").agg(F.coalesce(F.sum("n_replaced"), F.lit(0)).alias("n"), F.countDistinct("page_id").alias("n_pages"))
    return images.select(F.lit("image").alias("part"), "element", "attr", "trigger", "n", "n_pages").unionByName(names.select(F.lit("name").alias("part"), none.alias("element"), none.alias("attr"), none.alias("trigger"), "n", "n_pages"))
