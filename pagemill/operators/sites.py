"""References between the files of saved sites: collected, resolved, rewritten after moves, repaired and taken out.

Files are a table (site_id, rel_path, content) with one row for each path of a site. References leave their files as rows,
are answered by joins on equal keys, and come back to each file as one map or one array of edits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import paths, policy, urls
from pagemill.operators import extract, layout, markup
from pagemill.sources.tables import saved

FILE = ["site_id", "rel_path"]
HTML = r"(?i)\.(html?|xhtml|shtml|php[57s]?|phtml)\z"
CSS = r"(?i)\.css\z"
_CSS_REF = r"""(?i)url\(\s*(['"]?)([^'")]+)\1\s*\)|(@import\s+)(['"])([^'"]+)\4"""
EDITS = "array<struct<start:int,stop:int,new:string>>"
#: Most rows of a few short strings that are broadcast; about 300 bytes each, 60 MB.
SMALL = 200_000


def is_html(path: Column) -> Column:
    return path.rlike(HTML)


def is_css(path: Column) -> Column:
    return path.rlike(CSS)


def routed(files: DataFrame) -> DataFrame:
    """site_id, rel_path, route: what cleaning does with each file: page, server page (code of the server goes first), style, script, vector, map, or none. Templates and includes are pages only where they have server code."""
    ext = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)\z", 1))
    served = F.coalesce(extract.has_server_code(F.col("content")), F.lit(False))
    route = (
        F.when(ext.isin("html", "htm", "php"), F.when(served, "server page").otherwise("page"))
        .when(ext.isin(*policy.SERVER_EXTENSIONS), F.when(served, "server page").otherwise("none"))
        .when(ext == "css", "style")
        .when(ext.isin("js", "mjs"), "script")
        .when(ext == "svg", "vector")
        .when(ext == "map", "map")
        .otherwise("none")
    )
    return files.select(*FILE, route.alias("route"))


# ------------------------------------------------------------------- collected


def css_refs(css: Column) -> Column:
    """Addresses of url() and @import in a style sheet, data: left out."""
    hits = F.regexp_extract_all(F.coalesce(css, F.lit("")), F.lit(_CSS_REF), F.lit(0))
    return F.filter(F.transform(hits, _css_address), lambda u: (u != "") & ~u.rlike("^data:"))


def _css_address(m: Column) -> Column:
    return F.trim(F.concat(F.regexp_extract(m, _CSS_REF, 2), F.regexp_extract(m, _CSS_REF, 5)))


def srcset_refs(value: Column) -> Column:
    """The addresses of a srcset."""
    first = F.transform(F.split(value, ","), lambda p: F.regexp_extract(F.trim(p), r"^(\S*)", 1))
    return F.filter(first, lambda u: u != "")


def element_refs(e: Column) -> Column:
    """What an element of markup loads: addresses and srcsets of asset elements, addresses in styles."""
    asset = e["tag"].isin(*policy.ASSET_TAGS)

    def of(a: Column) -> Column:
        plain = F.when(F.trim(a["value"]) != "", F.array(F.trim(a["value"])))
        return F.coalesce(F.when(asset & a["name"].isin(*policy.ADDRESS_ATTRIBUTES), plain).when(asset & a["name"].isin(*policy.SRCSET_ATTRIBUTES), srcset_refs(a["value"])).when(a["name"] == "style", css_refs(a["value"])), F.array().cast("array<string>"))

    return F.concat(F.flatten(F.transform(e["attrs"], of)), F.when(e["tag"] == "style", css_refs(e["body"])).otherwise(F.array().cast("array<string>")))


_NAMES = [*policy.ADDRESS_ATTRIBUTES, *policy.SRCSET_ATTRIBUTES, "style"]


def _opened(files: DataFrame) -> DataFrame:
    """FILE, content, and of files of markup the elements that can hold an address."""
    return markup.with_elements(files.where(is_html(F.col("rel_path"))).select(*FILE, F.coalesce("content", F.lit("")).alias("html")), names=_NAMES, bare=False)


def _with_refs(files: DataFrame) -> DataFrame:
    """FILE, refs, base_href of each file of markup or style: the different addresses that it loads, and its first <base href>, if any; each file is opened once."""
    base = F.filter(F.transform(F.filter("elements", lambda e: e["tag"] == "base"), lambda e: markup.value_of(e["attrs"], "href")), lambda v: v.isNotNull())
    pages = _opened(files).select(*FILE, F.array_distinct(F.flatten(F.transform("elements", element_refs))).alias("refs"), F.try_element_at(base, F.lit(1)).alias("base_href"))
    sheets = files.where(is_css(F.col("rel_path"))).select(*FILE, F.array_distinct(css_refs(F.col("content"))).alias("refs"), F.lit(None).cast("string").alias("base_href"))
    return pages.unionByName(sheets)


def _each_ref(opened: DataFrame) -> DataFrame:
    return opened.select(*FILE, F.explode("refs").alias("raw")).where(~paths.is_skipped(F.col("raw")))


def references(files: DataFrame) -> DataFrame:
    """site_id, rel_path, raw: the different addresses that each file of markup or style loads, those that load nothing left out. Content of a noscript counts where it is a script, frame or image; null content has none."""
    return _each_ref(_with_refs(files))


# ------------------------------------------------------------------- rewritten


def _css_mapped(css: Column, new: Callable[[Column], Column]) -> Column:
    def one(m: Column) -> Column:
        target = new(_css_address(m))
        quote, imported, import_quote = (F.regexp_extract(m, _CSS_REF, i) for i in (1, 3, 4))
        rebuilt = F.when(imported != "", F.concat(imported, import_quote, target, import_quote)).otherwise(F.concat(F.lit("url("), quote, target, quote, F.lit(")")))
        return F.when(target.isNotNull(), rebuilt).otherwise(m)

    return extract.mapped(css, _CSS_REF, one)


def _srcset_mapped(value: Column, new: Callable[[Column], Column]) -> Column:
    def one(part: Column) -> Column:
        url, rest = F.regexp_extract(part, r"^(\S*)", 1), F.regexp_extract(part, r"(?s)^\S*(.*)\z", 1)
        return F.concat(F.coalesce(new(url), url), rest)

    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, one), ", ")


def rewritten(files: DataFrame, moves: DataFrame) -> DataFrame:
    """`files` (FILE, content) with the addresses in `moves` (FILE, raw, new: one row for each address of a file) replaced in one go: a new address is never looked at again, and one that is part of another doesn't matter, as whole values are compared.

    A file's addresses come to it as one map. Files without any, and null content, stay as they are.
    """
    maps = moves.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("map"))
    joined = files.join(maps, FILE, "left").withColumn("content", F.col("content"))
    new = lambda u: F.try_element_at(F.col("map"), u)
    rest = joined.where(F.col("map").isNull() | ~is_html(F.col("rel_path")))
    rest = rest.withColumn("content", F.when(F.col("map").isNotNull() & is_css(F.col("rel_path")), _css_mapped(F.col("content"), new)).otherwise(F.col("content"))).drop("map")
    pages = markup.with_elements(joined.where(F.col("map").isNotNull() & is_html(F.col("rel_path"))).withColumn("html", F.col("content")), names=_NAMES, bare=False)
    quoted = lambda v: F.concat(F.lit('="'), F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))

    def edits(e: Column) -> Column:
        asset = e["tag"].isin(*policy.ASSET_TAGS)

        def one(a: Column) -> Column:
            v = a["value"]
            value = F.when(asset & a["name"].isin(*policy.ADDRESS_ATTRIBUTES), new(F.trim(v))).when(asset & a["name"].isin(*policy.SRCSET_ATTRIBUTES) & F.exists(srcset_refs(v), lambda u: new(u).isNotNull()), _srcset_mapped(v, new)).when(a["name"] == "style", F.nullif(_css_mapped(v, new), v))
            return F.when(value.isNotNull(), F.struct(a["start"].alias("start"), a["stop"].alias("stop"), F.concat(F.lit(" "), a["name"], quoted(value)).alias("new")))

        body = _css_mapped(e["body"], new)
        style = F.when((e["tag"] == "style") & (body != e["body"]), F.struct(e["inner"].alias("start"), (e["inner"] + F.length(e["body"])).alias("stop"), body.alias("new")))
        return F.array_compact(F.concat(F.transform(e["attrs"], one), F.array(style)))

    planned = pages.select(*files.columns, "html", F.flatten(F.transform("elements", edits)).cast(EDITS).alias("edits"))
    done = markup.with_outermost(planned).withColumn("content", F.col("html")).select(*files.columns)
    return rest.select(*files.columns).unionByName(done)


# ----------------------------------------------------------------------- moves


def _known(files: DataFrame) -> DataFrame:
    return files.select("site_id", F.col("rel_path").alias("found"))


def local_refs(files: DataFrame, names: DataFrame) -> DataFrame:
    """FILE, raw, found: the relative addresses of `files` that are a file of the same site; `names` has all files (site_id, found)."""
    refs = references(files).where(paths.is_relative(F.col("raw"))).withColumn("found", paths.in_site(F.col("raw"), F.col("rel_path")))
    return refs.join(names, ["site_id", "found"]).select(*FILE, "raw", "found")


def moved(files: DataFrame, main: DataFrame, saved: Callable[[DataFrame, str], DataFrame], most: int = 100) -> DataFrame:
    """site_id, rel_path, round, target: what moves when the sites' main files (`main`: site_id, rel_path) go to index.html: the files that they load, and round by round those that moved style sheets load or import, wherever these lie.

    Each round joins the style sheets that came last with the files they load and takes out what has moved already, so
    imports in a circle end. `saved` writes a table and reads it again; a round's state is that table. A file goes to the
    folder of its kind. Where several have one name there, the one that lies there already keeps it, whether it is loaded
    or not; the others get _1, _2 behind theirs, by round, then by path.
    """
    names = saved(_known(files), "names")
    frontier = saved(local_refs(files.join(main.select(*FILE), FILE, "left_semi"), names).select("site_id", F.col("found").alias("rel_path")).distinct().join(main.select(*FILE), FILE, "left_anti").withColumn("round", F.lit(1)), "moves-1")
    done, n = frontier, 1
    while n < most:
        sheets = files.join(frontier.where(is_css(F.col("rel_path"))).select(*FILE), FILE, "left_semi")
        loads = sheets.select(*FILE, F.explode(F.filter(css_refs(F.col("content")), paths.is_relative)).alias("raw")).withColumn("found", paths.in_site(F.col("raw"), F.col("rel_path")))
        n += 1
        found = loads.select("site_id", "found").distinct().join(names, ["site_id", "found"], "left_semi").withColumnRenamed("found", "rel_path")
        frontier = saved(found.join(done, FILE, "left_anti").join(main.select(*FILE), FILE, "left_anti").withColumn("round", F.lit(n)), f"moves-{n}")
        if frontier.isEmpty():
            break
        done = saved(done.unionByName(frontier), f"moved-{n}")
    rows = names.withColumnRenamed("found", "rel_path").join(done, FILE, "left")
    rows = rows.withColumns({"dir": layout.directory(F.col("rel_path")), "name": F.regexp_extract("rel_path", r"([^/]*)\z", 1)})
    there = F.col("rel_path") == F.concat("dir", F.lit("/"), "name")
    rows = rows.where(F.col("round").isNotNull() | there)
    place = F.row_number().over(Window.partitionBy("site_id", "dir", "name").orderBy(F.desc(there), "round", "rel_path")) - 1
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?\z", 1), F.regexp_extract("name", r"(\.[^.]*)\z", 1)
    named = rows.withColumn("place", place).withColumn("target", F.concat("dir", F.lit("/"), F.when(F.col("place") > 0, F.concat(stem, F.lit("_"), F.col("place").cast("string"), ext)).otherwise(F.col("name"))))
    return named.where("round IS NOT NULL").select(*FILE, "round", "target")


def relocated(files: DataFrame, main: DataFrame, moves: DataFrame) -> DataFrame:
    """site_id, rel_path, content of `files` after `moves` (rows of moved(), saved): main files are index.html without server code, moved files lie at their targets, and the addresses of both lead to where the files lie now. Files that neither are main nor move stay as they are."""
    to = main.select(*FILE).withColumn("target", F.lit("index.html")).unionByName(moves.select(*FILE, "target"))
    names = _known(files)
    ours = files.select(*FILE, "content").join(to, FILE)
    rest = files.select(*FILE, "content").join(to.select(*FILE), FILE, "left_anti")
    suffix = F.regexp_extract("raw", r"(?s)^[^?#]*(.*)\z", 1)
    lead = local_refs(ours.select(*FILE, "content"), names).join(to.select("site_id", F.col("rel_path").alias("found"), F.col("target").alias("there")), ["site_id", "found"])
    lead = lead.join(to.withColumnRenamed("target", "here"), FILE).select(*FILE, "raw", F.concat(paths.relative(F.col("here"), F.col("there")), suffix).alias("new"))
    done = rewritten(ours.select(*FILE, "content", "target"), lead)
    stripped = F.when(F.col("target") == "index.html", extract.strip_server_code(F.col("content"))).otherwise(F.col("content"))
    return done.select("site_id", F.col("target").alias("rel_path"), stripped.alias("content")).unionByName(rest)


# ---------------------------------------------------------------------- repair


def best_by_name(names: DataFrame) -> DataFrame:
    """site_id, name, above, best: for each name and each folder above files of that name the two best files in it: a site's own before saved external ones, then the shortest path, then by path. The work is a row for each folder of a path, however many files share a name."""
    parts = F.filter(F.split(paths.directory(F.col("rel_path")), "/"), lambda p: p != "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = names.select("site_id", "rel_path", urls.basename(F.col("rel_path")).alias("name"), F.explode(folders).alias("above"), F.startswith("rel_path", F.lit("_external/")).alias("external"))
    first = Window.partitionBy("site_id", "name", "above", "external").orderBy(F.length("rel_path"), "rel_path")
    kept = rows.withColumn("place", F.row_number().over(first)).where("place <= 2")
    return kept.groupBy("site_id", "name", "above").agg(F.collect_list(F.struct("external", "rel_path")).alias("best"))


def candidates(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (site_id, from_path, name, and others; one row for each) with rel_path: the file of that name that its site has, but for from_path itself: own files before saved external ones, then the shortest way from from_path, then by path; null for none.

    A way's length is that of the folders to leave and of what follows, so a file that is best from somewhere is among the
    best two of its name in a folder above both: every row meets two of each kind in each of its folders.
    """
    keys = wanted.select("site_id", "from_path", "name").distinct()
    parts = F.filter(F.split(paths.directory(F.col("from_path")), "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("above"), (3 * (F.size(parts) - i)).alias("up")))
    rows = keys.select("site_id", "from_path", "name", F.inline(above)).join(best_by_name(names), ["site_id", "name", "above"]).select("site_id", "from_path", "name", "above", "up", F.inline("best"))
    cost = F.col("up") + F.length("rel_path") - F.when(F.col("above") == "", 0).otherwise(F.length("above") + 1)
    least = rows.where("rel_path <> from_path").groupBy("site_id", "from_path", "name").agg(F.min(F.struct("external", cost.alias("cost"), "rel_path"))["rel_path"].alias("rel_path"))
    return wanted.join(least, ["site_id", "from_path", "name"], "left")


def repaired(files: DataFrame) -> DataFrame:
    """site_id, rel_path, raw, outcome, new: what becomes of each address that a file loads. A row leaves at its first answer:

    kept: a relative one whose file is there, or one whose last segment names no file; by name: the site has a file of that
    name, `new` leads to the best (candidates()); external-no-local or local-missing: it hasn't.
    """
    names = files.select(*FILE)
    refs = saved(references(files), "references")  # read several times; files are opened once
    absolute = F.trim("raw").rlike(r"(?i)^(https?:)?//")
    refs = refs.withColumns({"absolute": absolute, "found": F.when(~absolute, paths.in_site(F.col("raw"), F.col("rel_path"))), "name": urls.basename(F.trim("raw"))})
    refs = refs.withColumn("name", F.when(absolute & (urls.path(F.trim("raw")).isin("", "/")), F.lit("")).otherwise(F.col("name")))
    there = refs.where("NOT absolute AND found IS NOT NULL").join(_known(files), ["site_id", "found"], "left_semi").select(*FILE, "raw", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("new"))
    rest = refs.join(there.select(*FILE, "raw"), [*FILE, "raw"], "left_anti")
    unnamed = rest.where(~F.contains("name", F.lit("."))).select(*FILE, "raw", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("new"))
    named = rest.where(F.contains("name", F.lit("."))).select("site_id", F.col("rel_path").alias("from_path"), "raw", "absolute", "name")
    answered = candidates(names, named).withColumnRenamed("rel_path", "best")
    miss = F.when(F.col("absolute"), F.lit("external-no-local")).otherwise(F.lit("local-missing"))
    told = answered.select("site_id", F.col("from_path").alias("rel_path"), "raw", F.when(F.col("best").isNotNull(), F.lit("by name")).otherwise(miss).alias("outcome"), F.when(F.col("best").isNotNull(), paths.shown(F.col("from_path"), F.col("best"))).alias("new"))
    return there.unionByName(unnamed).unionByName(told)


def missing_report(answers: DataFrame) -> DataFrame:
    """value: a line 'file | type | address | advice' for each address of repaired() that is nowhere."""
    advice = F.when(F.col("outcome") == "local-missing", F.lit("no such file in the site")).otherwise(F.lit("no local copy: fetch by hand"))
    return answers.where(F.col("outcome").isin("external-no-local", "local-missing")).select("site_id", F.concat_ws(" | ", "rel_path", "outcome", "raw", advice).alias("value"))


# --------------------------------------------------------------------- deleted


def without_deleted(files: DataFrame, deleted: DataFrame, small: int = SMALL) -> DataFrame:
    """site_id, rel_path, content, n_edits: files of markup without the scripts, links and images that load a file in `deleted` (site_id, rel_path). Files with server code stay as they are.

    Elements leave their pages as rows (file, address, offsets) and come back as one array of edits for each page that has
    any. `deleted` is counted: up to `small` rows are broadcast, more are joined by a shuffle; the pages come out alike.
    """
    pages = files.where(is_html(F.col("rel_path"))).select(*FILE, F.coalesce("content", F.lit("")).alias("html"))
    open_ones = pages.where(~extract.has_server_code(F.col("html")))
    found = markup.with_elements(open_ones, ("script", "link", "img"), ("src", "href")).select(*FILE, F.inline("elements")).where("within <> 'noscript'")
    raw = F.when(F.col("tag") == "link", markup.attribute("href")).otherwise(markup.attribute("src"))
    rows = found.select(*FILE, raw.alias("raw"), "start", "stop").where(F.col("raw").isNotNull() & ~urls.is_absolute(F.col("raw")))
    gone = deleted.select("site_id", F.col("rel_path").alias("found")).distinct()
    rows = rows.withColumn("found", paths.in_site(F.col("raw"), F.col("rel_path"))).join(gone.hint("broadcast" if gone.count() <= small else "merge"), ["site_id", "found"], "left_semi")
    edits = rows.groupBy(*FILE).agg(F.collect_list(F.struct("start", "stop", F.lit("").alias("new"))).cast(EDITS).alias("edits"))
    joined = pages.join(edits, FILE, "left")
    done = markup.with_outermost(joined.select(*FILE, "html", "edits"))
    return done.select(*FILE, F.col("html").alias("content"), F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias("n_edits"))


# --------------------------------------------------------------------- missing


def fetched(files: DataFrame, seen: DataFrame, responses: DataFrame, saved: Callable[[DataFrame, str], DataFrame], most: int = 2, own_only: bool = True) -> DataFrame:
    """site_id, url, rel_path, round, ok: the assets that files load and that nobody has asked for yet, round by round.

    `files` has FILE, content, url (where the file came from) and main_host; `seen` the addresses asked for (site_id, url);
    `responses` what can be had (url, body; null: nothing). A round asks for the addresses of the files that came last, but
    for those seen, of other hosts (with `own_only`) or without an asset's extension; what it gets are the next round's
    files. It ends when a round brings nothing, or after `most`. What was asked for is a table that each round adds to.
    """
    hosts = saved(files.select("site_id", "main_host").distinct(), "hosts")
    few = hosts.count() <= SMALL
    last, asked, out, n = files.select(*FILE, "content", "url"), saved(seen.select("site_id", "url").distinct(), "seen-0"), None, 0
    while n < most:
        n += 1
        opened = saved(_with_refs(last), f"opened-{n}")
        based = paths.with_resolved(opened.where("base_href IS NOT NULL").select(*FILE, "base_href").join(last.select(*FILE, "url"), FILE), "base_href", "url", "base").select(*FILE, "base")
        raw = _each_ref(opened).join(last.select(*FILE, "url"), FILE).join(based, FILE, "left").withColumn("base", F.coalesce("base", "url"))
        raw = paths.with_resolved(raw.select("site_id", "raw", "base"), "raw", "base", "url").select("site_id", "url")
        found = raw.where(F.col("url").rlike("^https?://")).distinct().join(hosts.hint("broadcast" if few else "merge"), "site_id")
        found = found.join(asked, ["site_id", "url"], "left_anti")
        found = found.withColumns({"own": urls.host(F.col("url")) == F.col("main_host"), "path": layout.local_path(F.col("url"))})
        found = found.withColumn("rel_path", F.when(F.col("own"), F.regexp_replace("path", r"^[^/]*/", "")).otherwise(F.concat(F.lit("_external/"), "path")))
        wanted = F.lower(F.regexp_extract("rel_path", r"\.([^./]*)\z", 1)).isin(*policy.ASSET_EXTENSIONS) & (F.col("own") | F.lit(not own_only))
        new = saved(found.select("site_id", "url", "rel_path", wanted.alias("wanted")).join(responses.select("url", "body"), "url", "left").withColumn("round", F.lit(n)), f"fetched-{n}")
        told = new.where("wanted").select("site_id", "url", "rel_path", "round", F.col("body").isNotNull().alias("ok"))
        out = told if out is None else out.unionByName(told)
        asked = saved(asked.unionByName(new.select("site_id", "url")), f"seen-{n}")
        last = new.where("wanted AND body IS NOT NULL").select(*FILE, F.col("body").alias("content"), "url")
        if last.isEmpty():
            break
    return out
