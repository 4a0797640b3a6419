"""Facts about a cleaning run, as aggregates over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import policy, urls
from pagemill.operators import extract


def by_kind(classified: DataFrame) -> DataFrame:
    return classified.groupBy("kind", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"), F.countDistinct("host").alias("n_hosts"))


def rolled_up(classified: DataFrame) -> DataFrame:
    return classified.rollup("kind", "action").agg(F.count(F.lit(1)).alias("n"))


def quarantine(classified: DataFrame) -> DataFrame:
    """The quarantined resources of each page, numbered from 1, with their file names."""
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "url", "reason")).cast("long")
    rows = classified.where("action = 'quarantine'").withColumn("number", number)
    padded = F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))
    return rows.select("page_id", "kind", "url", "reason", "number", F.concat(padded, F.lit("-"), "kind", F.lit(".txt")).alias("file"))


def first_changes(classified: DataFrame, most: int = 100) -> DataFrame:
    """The first `most` changes of each reason; Spark keeps no more than those in each task before they meet."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy("page_id", "kind", "url")).cast("long")
    return classified.where("action <> 'keep'").withColumn("place", place).where(F.col("place") <= most).select("reason", "page_id", "url", "place")


def verified(requests: DataFrame) -> DataFrame:
    """One row over all runs: fine if there are any and none has an error; the hosts that aren't trusted."""
    rows = requests.withColumn("h", urls.host(F.col("url")))
    foreign = F.col("h").isNotNull() & ~urls.in_domains(F.col("h"), policy.TRUSTED_LIB_HOSTS)
    return rows.agg(
        F.count(F.lit(1)).alias("n_runs"),
        ((F.count(F.lit(1)) > 0) & F.bool_and(~F.col("is_error"))).alias("ok"),
        F.countDistinct("page").alias("n_pages"),
        F.count_if(foreign).alias("n_foreign"),
        F.array_join(F.array_sort(F.collect_set(F.when(foreign, F.col("h")))), " ").alias("foreign_hosts"),
    )


def change_sections(classified: DataFrame, most: int = 100) -> DataFrame:
    """reason, n, n_shown, note: a section of the report for each reason: all changes, those that are listed, and the line that tells of the others."""
    rows = classified.where("action <> 'keep'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    more = F.col("n") - most
    return rows.select("reason", "n", F.least("n", F.lit(most).cast("long")).alias("n_shown"), F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))).alias("note"))


#: Signs of code that waits for events, and so may be alive without having run.
HANDLERS = r"\.addEventListener\s*\(|(?<![\w$.])(?:jQuery|\$)\s*\(|\.on[a-z]+\s*=(?!=)"


def dead_files(coverage: DataFrame, files: DataFrame, threshold: float = 1.0) -> DataFrame:
    """site_id, rel_path, percent, has_handlers, is_dead: files of `files` (site_id, rel_path, content) of which no more than `threshold` percent ran, by `coverage` (site_id, rel_path, percent; null paths are inline scripts and have no part). Such a file is dead unless it waits for events; null content waits for none."""
    low = coverage.where(F.col("rel_path").isNotNull() & (F.col("percent") <= threshold))
    waits = F.coalesce(F.col("content").rlike(HANDLERS), F.lit(False))
    return low.join(files, ["site_id", "rel_path"]).select("site_id", "rel_path", "percent", waits.alias("has_handlers"), (~waits).alias("is_dead"))


KINDS, ACTIONS = ("script", "stylesheet", "iframe", "img", "media", "anchor"), ("keep", "remove", "quarantine")
MEASURES = ["pages", "server_pages", "inline_scripts", "tracker_scripts", "suspicious_scripts", "script_warnings", "own_macros", "foreign_macros", *[f"{k}_{a}" for k in KINDS for a in ACTIONS]]


def site_stats(pages: DataFrame) -> DataFrame:
    """site_id and the MEASURES (long; 0 where there are none), a row for each site of `pages` (site_id, html).

    Every measure is rows (site, measure, n) that are added up where they are made, so one small shuffle brings them all together
    and a site with a third of the pages sends no more rows than another. Null html is an empty page; a null site_id is a site.
    """
    by_site = pages.select(F.col("site_id").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    measure = lambda rows, name, n: rows.select(F.col("page_id").alias("site_id"), (F.lit(name) if isinstance(name, str) else name).alias("measure"), n.cast("long").alias("n"))
    one, count = F.lit(1), lambda condition: F.when(condition, 1).otherwise(0)
    scripts = extract.inline_scripts(by_site)
    resources = extract.classified(by_site)
    tokens = extract.macros(by_site)
    warnings = sum((F.regexp_count("body", F.lit(p)) for _, p in policy.JS_WARNINGS), F.lit(0))

    def several(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
        made = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), n.cast("long").alias("n")) for name, n in parts.items()]))
        return rows.select(F.col("page_id").alias("site_id"), made.alias("m")).select("site_id", "m.measure", "m.n")

    whole = several(by_site, {"pages": one, "server_pages": count(extract.has_server_code(F.col("html")))})
    whole = whole.unionByName(several(scripts, {"inline_scripts": one, "tracker_scripts": count(F.size(extract.keywords_in(F.col("body"))) > 0), "suspicious_scripts": count(extract.suspicious(F.col("body"))), "script_warnings": warnings}))
    whole = whole.unionByName(measure(resources, F.concat("kind", F.lit("_"), "action"), one)).unionByName(measure(tokens, F.when(F.col("own"), "own_macros").otherwise("foreign_macros"), F.col("n")))
    wide = whole.groupBy("site_id").pivot("measure", MEASURES).sum("n")
    return wide.select("site_id", *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES])


def site_verdicts(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """site_id, ok, verdict: what a person reads about each site of `runs` (site_id, page, profile, loaded, n_errors, difference (percent or null), has_quiz), with the foreign hosts of `requests` (site_id, url).

    A site is ok if every run loaded without errors and asked no host that isn't trusted. Null flags and counts count as false and 0. Sites without requests have no foreign ones; sites without runs have no row.
    """
    h = urls.host(F.col("url"))
    strange = requests.select("site_id", h.alias("h")).where(F.col("h").isNotNull() & ~urls.in_domains(F.col("h"), policy.TRUSTED_LIB_HOSTS))
    foreign = strange.groupBy("site_id").agg(F.countDistinct("h").alias("n_foreign")).withColumnRenamed("site_id", "asked")
    told = runs.groupBy("site_id").agg(
        F.bool_and(F.coalesce("loaded", F.lit(False))).alias("loaded"),
        F.countDistinct("page").alias("n_pages"),
        F.array_join(F.array_sort(F.collect_set("profile")), "+").alias("profiles"),
        F.sum(F.coalesce("n_errors", F.lit(0))).alias("n_errors"),
        F.max("difference").alias("difference"),
        F.bool_or(F.coalesce("has_quiz", F.lit(False))).alias("has_quiz"),
    )
    rows = told.join(foreign, F.col("site_id").eqNullSafe(F.col("asked")), "left").withColumn("n_foreign", F.coalesce("n_foreign", F.lit(0)))
    differs = F.concat(F.lit("looks different by up to "), F.format_string("%.1f", F.round("difference", 1)), F.lit("%"), F.when(F.col("difference") > policy.VISUAL_LIMIT, ", look at the layout").otherwise(""))
    parts = F.concat_ws(
        "; ",
        F.when(~F.col("loaded"), "pages did NOT load, nothing is proven"),
        F.when(F.col("n_foreign") == 0, "no requests to foreign hosts").otherwise(F.concat(F.col("n_foreign").cast("string"), F.lit(" FOREIGN hosts asked"))),
        F.concat(F.lit("pages: "), F.col("n_pages").cast("string"), F.lit(", profiles: "), "profiles"),
        F.when(F.col("n_errors") > 0, F.concat(F.col("n_errors").cast("string"), F.lit(" errors of scripts"))),
        F.when(F.col("difference").isNotNull(), differs),
        F.when(F.col("has_quiz"), "has a quiz, click through it by hand"),
    )
    return rows.select("site_id", (F.col("loaded") & (F.col("n_foreign") == 0) & (F.col("n_errors") == 0)).alias("ok"), parts.alias("verdict"))


def page_order(files: DataFrame) -> DataFrame:
    """site_id, rel_path, place (from 1): the pages at the top of each site in the order in which they are checked: index.html first, then by name."""
    pages = files.where(F.col("rel_path").rlike(r"(?i)^[^/]+\.html?\z"))
    first = Window.partitionBy("site_id").orderBy(F.col("rel_path") != "index.html", "rel_path")
    return pages.select("site_id", "rel_path", F.row_number().over(first).cast("long").alias("place"))
