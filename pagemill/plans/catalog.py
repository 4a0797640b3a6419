"""Every query by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import paths, policy, urls
from pagemill.operators import adapt, extract, html, layout, markup, report, scripts, sites, spans
from pagemill.plans import fixtures as fx
from pagemill.plans import oracle as o
from pagemill.sources import config
from pagemill.sources.tables import saved

FLAGSHIP = "classify_resources"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with one of the fixture's snippets behind each, by page_id (pages without one get the first)."""
    return with_snippets(spark, sf_dir, fx.SNIPPETS)


def with_snippets(spark: SparkSession, sf_dir: str, snippets: fx.Fixture) -> DataFrame:
    """The pages with one of seven snippets behind each; # in a snippet stands for the page's number."""
    slot = F.coalesce(F.pmod("page_id", F.lit(7)), F.lit(0))
    rows = pages(spark, sf_dir).join(F.broadcast(snippets.df(spark)), slot == F.col("slot"), "left")
    return rows.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.replace("markup", F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("html"))


def coded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with server code, scripts, styles, links and macros behind them."""
    return with_snippets(spark, sf_dir, fx.CODE)


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, start_pos, end_pos, hits: spans from the line items of each supplier; quantities round to even, as SQL's cast does."""
    start = (F.col("l_partkey") % 500).cast("int")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("f"), "l_suppkey").alias("file"), start.alias("start_pos"), F.bround(start + F.col("l_quantity")).cast("int").alias("end_pos"), (F.col("l_linenumber") % 3).cast("int").alias("hits"))


@query(f"SELECT page_id, kind, url, action, reason, host FROM ({o.VERDICTS.format(rows=o.RESOURCES)})")
def classify_resources(spark, sf_dir):
    return extract.classified(marked_pages(spark, sf_dir))


@query(f"SELECT page_id, count(*) AS n_anchors, CAST(count_if(starts_with(href, '/')) AS BIGINT) AS n_root, CAST(count_if(starts_with(href, '#')) AS BIGINT) AS n_fragment, CAST(count_if(regexp_matches(href, '(?i)^(https?:)?//')) AS BIGINT) AS n_absolute FROM ({o.ANCHORS}) GROUP BY page_id")
def anchor_inventory(spark, sf_dir):
    href = F.col("href")
    return extract.anchors(marked_pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.count_if(href.startswith("/")).alias("n_root"), F.count_if(href.startswith("#")).alias("n_fragment"), F.count_if(urls.is_absolute(href)).alias("n_absolute"))


@query(rf"SELECT page_id, count(*) AS n_links, CAST(count_if(trim(href) <> '' AND NOT regexp_matches(trim(href), '(?i)^(#|mailto:|tel:)') AND NOT regexp_matches(trim(href), '^\{{[a-zA-Z0-9_:.\-]+\}}$')) AS BIGINT) AS n_offer FROM ({o.ANCHORS}) GROUP BY page_id")
def offer_links(spark, sf_dir):
    return extract.anchors(marked_pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(extract.becomes_offer(F.col("href"))).alias("n_offer"))


@query(f"SELECT page_id, {o.scheme('url')} AS scheme, {o.host('url')} AS host, {o.path('url')} AS path, {o.basename('url')} AS basename, regexp_extract(url, '\\?([^#]*)', 1) AS query_text FROM pages")
def url_components(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.basename(u).alias("basename"), F.regexp_extract(u, r"\?([^#]*)", 1).alias("query_text"))


@query(f"SELECT {o.host('url')} AS host, count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars, CAST(max(length(html)) AS BIGINT) AS longest FROM pages GROUP BY 1")
def page_host_stats(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("html").cast("long")).alias("n_chars"), F.max(F.length("html").cast("long")).alias("longest"))


@query(f"SELECT page_id, count(*) AS n_scripts, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM ({o.INLINE}) GROUP BY page_id")
def inline_script_stats(spark, sf_dir):
    return extract.inline_scripts(marked_pages(spark, sf_dir)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_scripts"), F.sum(F.length("body").cast("long")).alias("n_chars"))


@query(f"SELECT page_id, length(body) AS n_chars, array_to_string(found, ' ') AS found FROM (SELECT page_id, body, list_filter({o.array(policy.INLINE_KEYWORDS)}, lambda k: contains(body, k)) AS found FROM ({o.INLINE})) WHERE len(found) > 0")
def keyword_hits(spark, sf_dir):
    found = extract.inline_scripts(marked_pages(spark, sf_dir)).withColumn("k", extract.keywords_in(F.col("body"))).where(F.size("k") > 0)
    return found.select("page_id", F.length("body").cast("long").alias("n_chars"), F.array_join("k", " ").alias("found"))


@query(f"SELECT page_id, token, token IN {o.values(policy.OWN_MACROS)} AS own, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g'), '\\{{[a-zA-Z0-9_:.\\-]+\\}}')) AS token FROM {o.MARKED}) GROUP BY page_id, token")
def macro_tokens(spark, sf_dir):
    return extract.macros(marked_pages(spark, sf_dir))


CSS_BLOCKS = {"n_styles": r"(?is)<style[^>]*>.*?</style>", "n_urls": r"(?i)url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", "n_imports": r"(?i)@import\s+['\"]([^'\"]+)['\"]"}


@query(f"SELECT page_id, {', '.join(f'len(regexp_extract_all(html, {o.text(p)}))::BIGINT AS {n}' for n, p in CSS_BLOCKS.items())} FROM {o.MARKED}")
def css_blocks(spark, sf_dir):
    return marked_pages(spark, sf_dir).select("page_id", *[F.size(extract.all_of(F.col("html"), p, 0)).cast("long").alias(n) for n, p in CSS_BLOCKS.items()])


@query(f"SELECT entity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '&(#?[a-zA-Z0-9]+);', 1)) AS entity FROM pages) GROUP BY entity")
def entity_counts(spark, sf_dir):
    return pages(spark, sf_dir).select(F.explode(extract.all_of(F.col("html"), r"&(#?[a-zA-Z0-9]+);")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT host, count(*) AS n FROM (SELECT DISTINCT r.page_id, r.url, {o.host('r.url')} AS host FROM ({o.RESOURCES}) r) WHERE len(list_filter({o.array(o.TRACKERS)}, lambda t: host = t OR ends_with(host, '.' || t))) > 0 GROUP BY host")
def tracker_suffix_join(spark, sf_dir):
    """Suffix match as an equality: the domains above each host against the list, which is fixed."""
    names = F.broadcast(spark.createDataFrame([(t,) for t in policy.TRACKER_HOSTS if "/" not in t], "domain string"))
    hosts = extract.resources(marked_pages(spark, sf_dir)).withColumn("host", urls.host(F.col("url"))).where("host IS NOT NULL").select("page_id", "url", "host").distinct()
    hit = hosts.withColumn("domain", F.explode(urls.domains(F.col("host")))).join(names, "domain", "left_semi").select("page_id", "url", "host").distinct()
    return hit.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def _hosts(spark, sf_dir, trusted):
    found = extract.resources(marked_pages(spark, sf_dir)).withColumn("host", urls.host(F.col("url"))).where("host IS NOT NULL")
    return found.where(urls.in_domains(F.col("host"), policy.TRUSTED_LIB_HOSTS) == trusted).groupBy("kind", "host").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT kind, host, count(*) AS n FROM (SELECT *, {o.host('url')} AS host FROM ({o.RESOURCES})) WHERE host IS NOT NULL AND {o.below('host', policy.TRUSTED_LIB_HOSTS)} GROUP BY kind, host")
def trusted_semi(spark, sf_dir):
    return _hosts(spark, sf_dir, True)


@query(f"SELECT kind, host, count(*) AS n FROM (SELECT *, {o.host('url')} AS host FROM ({o.RESOURCES})) WHERE host IS NOT NULL AND NOT {o.below('host', policy.TRUSTED_LIB_HOSTS)} GROUP BY kind, host")
def untrusted_anti(spark, sf_dir):
    return _hosts(spark, sf_dir, False)


@query(f"SELECT page_id, rel, kind, CASE WHEN kind IS NOT NULL THEN action END AS action FROM ({o.VERDICTS.format(rows='(SELECT page_id, rel, ' + o.LINK_KIND + ' AS kind, href AS url FROM ' + o.CODE_LINKS + ')')})")
def link_rel_kind(spark, sf_dir):
    """What the links of pages load, and the verdict on it."""
    links = markup.elements(coded_pages(spark, sf_dir), ("link",), ("rel", "as", "href"))
    kind = extract.link_kind(markup.attribute("rel"), markup.attribute("as"))
    rows = links.select("page_id", markup.attribute("rel").alias("rel"), kind.alias("kind"), markup.attribute("href").alias("href"))
    return rows.select("page_id", "rel", "kind", F.when(F.col("kind").isNotNull(), urls.verdict(F.col("href"), F.col("kind"))["action"]).alias("action"))


@query(f"SELECT site_id, rel_path, score FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, rel_path) AS place FROM ({o.main_score(o.SITE_SIZES)})) WHERE place = 1")
def main_file_top1(spark, sf_dir):
    """The main file of each saved site."""
    return layout.main_files(site_files(spark, sf_dir).withColumn("size", F.length("content").cast("long")))


@query(f"SELECT host, rel_path, score FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, rel_path) AS place FROM ({o.main_score(o.PAGE_FILES)})) WHERE place = 1")
def main_page_top1(spark, sf_dir):
    """The page of each host that looks most like its main page."""
    name = F.regexp_replace(F.regexp_replace(urls.path(F.col("url")), "^/", ""), r"/\z", "")
    files = pages(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), F.concat(F.when(name == "", F.lit("index")).otherwise(name), F.lit(".html")).alias("rel_path"), F.col("html").alias("content"), F.length("html").cast("long").alias("size"))
    return layout.main_files(files, "host")


@query(f"SELECT site_id, rel_path, CASE WHEN n > 0 THEN dir || '/' || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || regexp_extract(name, '(\\.[^.]*)$', 1) ELSE dir || '/' || name END AS target FROM (SELECT *, row_number() OVER (PARTITION BY site_id, dir, name ORDER BY rel_path) - 1 AS n FROM (SELECT site_id, rel_path, {o.directory('rel_path')} AS dir, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM {o.SITE_FILES}))")
def dup_basename_suffix(spark, sf_dir):
    return layout.placed(site_files(spark, sf_dir))


@query(f"SELECT file, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM ({o.ISLANDS.format(rows=o.RANGES)}) GROUP BY file, island")
def interval_islands(spark, sf_dir):
    return spans.merged(ranges(spark, sf_dir))


@query(f"SELECT f.file, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS covered FROM (SELECT DISTINCT file FROM {o.RANGES}) f LEFT JOIN (SELECT file, min(start_pos) AS s, max(end_pos) AS e FROM ({o.ISLANDS.format(rows='(SELECT * FROM ' + o.RANGES + ' WHERE hits > 0)')}) GROUP BY file, island) m ON f.file = m.file GROUP BY f.file")
def covered_characters(spark, sf_dir):
    return spans.covered(ranges(spark, sf_dir))


@query(f"SELECT file, start_pos, end_pos, hits FROM (SELECT *, max(end_pos) OVER (PARTITION BY file ORDER BY start_pos, end_pos DESC, hits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {o.RANGES}) WHERE reach IS NULL OR start_pos >= reach")
def outermost_spans(spark, sf_dir):
    return spans.outermost(ranges(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT page_id, '{name}' AS name, value FROM ({o.attribute('[a-z][^\\s/>]*', name)})" for name in ("onclick", "onload", "onerror", "onsubmit", "onchange", "onmouseover", "onfocus", "oninput")))
def event_attributes(spark, sf_dir):
    found = markup.elements(marked_pages(spark, sf_dir)).where("within <> 'noscript'").select("page_id", F.explode("attrs").alias("a"))
    return found.where(F.col("a.name").rlike("^on[a-z]")).select("page_id", "a.name", "a.value")


@query(" UNION ALL ".join(f"SELECT page_id, '{label}' AS label, len(regexp_extract_all(html, {o.text(p)}))::BIGINT AS n FROM {o.CODED} WHERE regexp_matches(html, {o.text(p)})" for label, p in policy.PHP_BACKDOORS))
def php_patterns(spark, sf_dir):
    return coded_pages(spark, sf_dir).select("page_id", F.inline(extract.labelled(F.col("html"), policy.PHP_BACKDOORS)))


@query(" UNION ALL ".join(f"SELECT page_id, {o.text(label)} AS label, len(regexp_extract_all(body, {o.text(p)}))::BIGINT AS n FROM ({o.INLINE}) WHERE regexp_matches(body, {o.text(p)})" for label, p in policy.JS_WARNINGS))
def js_warnings(spark, sf_dir):
    return extract.inline_scripts(marked_pages(spark, sf_dir)).select("page_id", F.inline(extract.labelled(F.col("body"), policy.JS_WARNINGS)))


@query(f"SELECT page_id, ids, hex_ids, hex_ids * 100 > ids * 15 OR contains(code, 'eval(function(p,a,c,k,e') OR regexp_matches(code, 'String\\[[''\"]fromCharCode[''\"]\\]') AS obfuscated FROM (SELECT *, len(regexp_extract_all(code, '[A-Za-z_$][\\w$]*'))::BIGINT AS ids, len(regexp_extract_all(code, '_0x[0-9a-fA-F]+'))::BIGINT AS hex_ids FROM {o.CODE_SCRIPTS})")
def obfuscation_ratio(spark, sf_dir):
    scripts_ = extract.inline_scripts(coded_pages(spark, sf_dir).select("page_id", "html"))
    return scripts_.select("page_id", extract.obfuscation(F.col("body")).alias("o")).select("page_id", "o.ids", "o.hex_ids", "o.obfuscated")


@query(f"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<\\?(?:php|=).*?\\?>', '', 'g'), '(?is)<\\?(?:[^xp=]|x[^m]|p[^h]).*?\\?>', '', 'g'), '(?is)<%.*?%>', '', 'g'), '(?is)<\\?(?:php|=).*', '', 'g')) AS stripped FROM {o.CODED}")
def server_tags(spark, sf_dir):
    """Digests of the pages without server code."""
    return coded_pages(spark, sf_dir).select("page_id", F.md5(extract.strip_server_code(F.col("html"))).alias("stripped"))


@query("SELECT page_id, replace(replace(replace(code, '@import ''https://evil.test/a.css'';', ''), 'url(\"https://evil.test/x-' || page_id || '.png\")', 'url(' || chr(39) || chr(39) || ')'), '@import url(''https://evil.test/css?a=1;2'');', '') AS cleaned FROM " + o.CODE_STYLES)
def css_clean(spark, sf_dir):
    """The style elements of pages without external imports and addresses; the oracle takes out the fixture's foreign ones."""
    sheets = markup.elements(coded_pages(spark, sf_dir), ("style",), ())
    return sheets.select("page_id", extract.clean_css(F.col("body")).alias("cleaned"))


@query(f"SELECT case_id AS page_id, lib, version, replace(target, '{{v}}', version) AS cdn_url FROM ({o.LIBRARIES.format(rows='(SELECT DISTINCT * FROM ' + o.CODE_URLS + ')')})")
def library_by_url(spark, sf_dir):
    """Libraries that pages load, by file name."""
    loaded = markup.elements(coded_pages(spark, sf_dir), ("script", "link"), ("src", "href"))
    rows = loaded.select("page_id", F.when(F.col("tag") == "script", markup.attribute("src")).otherwise(markup.attribute("href")).alias("url")).distinct()
    return rows.select("page_id", extract.library(F.col("url")).alias("l")).where("l IS NOT NULL").select("page_id", "l.lib", "l.version", "l.cdn_url")


@query(f"SELECT page_id, url, main_host, {o.IS_OFFER} AS offer FROM (SELECT r.page_id, r.url, {o.host('p.url')} AS main_host FROM ({o.RESOURCES}) r JOIN pages p ON p.page_id = r.page_id WHERE r.kind = 'anchor')")
def offer_urls(spark, sf_dir):
    rows = markup.with_elements(marked_pages(spark, sf_dir)).select("page_id", urls.host(F.col("url")).alias("main_host"), F.inline("elements"))
    rows = rows.where("tag IN ('a', 'area') AND within <> 'noscript'").select("page_id", "main_host", markup.attribute("href").alias("url")).where("url IS NOT NULL")
    return rows.select("page_id", "url", "main_host", F.coalesce(extract.is_offer(F.col("url"), F.col("main_host")), F.lit(False)).alias("offer"))


@query(f"SELECT kind, action, count(*) AS n, count(DISTINCT page_id) AS n_pages, count(DISTINCT host) AS n_hosts FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) GROUP BY kind, action")
def stats_by_kind(spark, sf_dir):
    return report.by_kind(extract.classified(marked_pages(spark, sf_dir)))


@query(f"SELECT kind, action, count(*) AS n FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) GROUP BY ROLLUP (kind, action)")
def stats_rollup(spark, sf_dir):
    return report.rolled_up(extract.classified(marked_pages(spark, sf_dir)))


@query(f"SELECT page_id, kind, url, reason, number, lpad(CAST(number AS VARCHAR), 3, '0') || '-' || kind || '.txt' AS file FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY kind, url, reason) AS BIGINT) AS number FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) WHERE action = 'quarantine')")
def quarantine_index(spark, sf_dir):
    return report.quarantine(extract.classified(marked_pages(spark, sf_dir)))


@query(f"SELECT reason, page_id, url, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY reason ORDER BY page_id, kind, url) AS BIGINT) AS place FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) WHERE action <> 'keep') WHERE place <= 100")
def changelog_first_100(spark, sf_dir):
    """The report's first hundred changes of each reason."""
    return report.first_changes(extract.classified(marked_pages(spark, sf_dir)))


@query(f"SELECT count(*) AS n_runs, count(*) > 0 AND bool_and(NOT is_error) AS ok, count(DISTINCT page) AS n_pages, CAST(count_if(h IS NOT NULL AND NOT {o.below('h', policy.TRUSTED_LIB_HOSTS)}) AS BIGINT) AS n_foreign, array_to_string(list_sort(list_distinct(list(h) FILTER (h IS NOT NULL AND NOT {o.below('h', policy.TRUSTED_LIB_HOSTS)}))), ' ') AS foreign_hosts FROM (SELECT *, {o.host('url')} AS h FROM {o.REQUESTS})")
def verify_fold(spark, sf_dir):
    """The verdict on all that pages load, taken as recorded requests."""
    loaded = extract.resources(marked_pages(spark, sf_dir)).where("kind <> 'anchor'")
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    return report.verified(loaded.select(page.alias("page"), F.when(F.col("page_id") % 2 == 0, "desktop").otherwise("mobile").alias("profile"), "url", F.lit(False).alias("is_error")))


@query(f"SELECT arg_max(default_vertical, layer) FILTER (default_vertical IS NOT NULL) AS default_vertical, arg_max(name_macro, layer) FILTER (name_macro IS NOT NULL) AS name_macro FROM {fx.CONFIG.sql()}")
def config_layering(spark, sf_dir):
    return adapt.layered(fx.CONFIG.df(spark))


@query(f"SELECT case_id, CASE WHEN image_mode = 'skip' THEN NULL WHEN image_mode = 'file' THEN image_file ELSE CASE trim(coalesce(vertical, 'Adult')) " + " ".join(f"WHEN {o.text(k)} THEN {o.text(v)}" for k, v in adapt.IMAGE_BASES.items()) + f" END END AS target FROM {o.BRIEFS}")
def image_target(spark, sf_dir):
    kind = F.col("page_id") % 4
    vertical = F.when(kind == 1, "Adult").when(kind == 2, " WeightLoss ").when(kind == 3, "None")
    mode = F.when(F.col("page_id") % 5 == 0, "skip").when(F.col("page_id") % 5 == 1, "file").otherwise("macro")
    briefs = pages(spark, sf_dir).select(F.col("page_id").alias("case_id"), vertical.alias("vertical"), mode.alias("image_mode"), F.concat(F.lit("img/"), "page_id", F.lit(".png")).alias("image_file"))
    return briefs.select("case_id", adapt.image_target(F.col("vertical"), F.col("image_mode"), F.col("image_file")).alias("target"))


NAMES = ["the and", "of"]


@query(r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '[^\x00-\x7F]', ' ', 'g'), '(?i)\bthe\s+and\b|\bof\b')) AS BIGINT) AS n FROM pages")
def product_name_hits(spark, sf_dir):
    """Where product names stand as whole words, what is beyond ASCII taken as space: the oracle's word boundary knows only ASCII."""
    plain = F.regexp_replace("html", r"[^\x00-\x7F]", " ")
    return pages(spark, sf_dir).select("page_id", F.regexp_count(plain, F.lit(adapt.names_pattern(NAMES))).cast("long").alias("n"))


@query(fx.RENAMED.sql()[1:-1])
def product_name_cases(spark, sf_dir):
    """Names in texts, attributes, metas, markup and scripts, against the expected pages."""
    return adapt.names_replaced(fx.NAMED.df(spark), ["Vital Boost", "foo"])


_NAME_COUNTS = r"SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<(script|style|pre|code|textarea|noscript)\b.*?</(script|style|pre|code|textarea|noscript)>|<!--.*?-->|<[^>]*>', '|', 'g'), '[^\x00-\x7F]', 'x', 'g'), '(?i)\bthe\s+and\b|\bof\b')) AS BIGINT) AS n_replaced FROM pages"


@query(_NAME_COUNTS)
def product_name_replace(spark, sf_dir):
    """How many names the texts of every page lose to the macro."""
    return adapt.names_replaced(pages(spark, sf_dir), NAMES).select("page_id", "n_replaced")


TARGET = adapt.IMAGE_BASES["Adult"]


@query(o.image_changes(TARGET, list(adapt.IMAGE_BASES.values())))
def product_images(spark, sf_dir):
    """What becomes of product images, pictures and styles of every page."""
    changed = adapt.images_replaced(with_snippets(spark, sf_dir, fx.IMAGES), TARGET)
    return changed.select("page_id", F.inline("changes"))


@query(f"SELECT page_id, CAST(count(*) AS BIGINT) AS n_first, CAST(0 AS BIGINT) AS n_again FROM ({o.image_changes(TARGET, list(adapt.IMAGE_BASES.values()))}) GROUP BY page_id")
def product_images_again(spark, sf_dir):
    """Changes of a first and of a second run over its pages."""
    first = adapt.images_replaced(with_snippets(spark, sf_dir, fx.IMAGES), TARGET)
    again = adapt.images_replaced(first, TARGET).select("page_id", F.size("changes").cast("long").alias("n_again"))
    return first.select("page_id", F.size("changes").cast("long").alias("n_first")).where("n_first > 0").join(again, "page_id")


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.sha2("html", 256).alias("sha256"))


@query()
def sri_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.concat(F.lit("sha384-"), F.base64(F.unhex(F.sha2("html", 384)))).alias("integrity"))


@query(f"SELECT page_id, url, {o.LOCAL_PATH} AS local_path FROM pages")
def url_to_local_path(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", layout.local_path(F.col("url")).alias("local_path"))


@query(f"SELECT extension, {o.directory('basename')} AS dir, count(*) AS n FROM (SELECT regexp_extract(basename, '\\.([a-z0-9]+)$', 1) AS extension, basename FROM (SELECT {o.basename('url')} AS basename FROM ({o.RESOURCES}))) GROUP BY 1, 2")
def extension_directories(spark, sf_dir):
    rows = extract.resources(marked_pages(spark, sf_dir)).select(urls.basename(F.col("url")).alias("basename"))
    return rows.groupBy(urls.extension(F.col("basename")).alias("extension"), layout.directory(F.col("basename")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT value AS name, count(*) AS n FROM ({o.attribute('meta', 'name')}) WHERE lower(value) IN {o.values([m.lower() for m in policy.VERIFICATION_METAS])} GROUP BY 1")
def verification_metas(spark, sf_dir):
    found = markup.elements(marked_pages(spark, sf_dir)).where("tag = 'meta'").select(markup.attribute("name").alias("name"))
    return found.where(F.lower("name").isin(*[m.lower() for m in policy.VERIFICATION_METAS])).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CAST(length(html) AS BIGINT) AS chars_before, CAST(length(a) AS BIGINT) AS chars_after, round(100.0e0 * (length(html) - length(a)) / length(html), 2) AS percent FROM (SELECT page_id, html, regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g') AS a FROM pages)")
def size_delta(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.length("html").cast("long").alias("chars_before"), F.length(extract.text_only(F.col("html"))).cast("long").alias("chars_after"))
    return rows.withColumn("percent", F.round(100.0 * (F.col("chars_before") - F.col("chars_after")) / F.col("chars_before"), 2))


@query()
def clean_pages(spark, sf_dir):
    """Cleaned markup of every page, by edit planning in the row."""
    return html.cleaned(marked_pages(spark, sf_dir), policy.POLICY_TAG)


@query(fx.CLEANED.sql()[1:-1])
def clean_cases(spark, sf_dir):
    """A page for each pass, against the expected pages."""
    return html.cleaned(fx.DIRTY.df(spark), "<meta policy>")


@query(f"SELECT page_id, n_imgs, n_gone, CAST(n_imgs - n_gone AS BIGINT) AS n_left FROM (SELECT page_id, CAST(count(*) AS BIGINT) AS n_imgs, CAST(count_if(action <> 'keep') AS BIGINT) AS n_gone FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) WHERE kind = 'img' GROUP BY page_id)")
def cleaned_images(spark, sf_dir):
    """Images of every page before and after cleaning."""
    dirty = extract.classified(marked_pages(spark, sf_dir)).where("kind = 'img'").select("page_id", F.lit(False).alias("after"), (F.col("action") != "keep").alias("gone"))
    left = extract.resources(html.cleaned(marked_pages(spark, sf_dir), policy.POLICY_TAG)).where("kind = 'img'").select("page_id", F.lit(True).alias("after"), F.lit(False).alias("gone"))
    counts = dirty.unionByName(left).groupBy("page_id").agg(F.count_if(~F.col("after")).alias("n_imgs"), F.count_if("gone").alias("n_gone"), F.count_if("after").alias("n_left"))
    return counts.where("n_imgs > 0")


@query(o.EDIT_COUNTS)
def edit_plan(spark, sf_dir):
    """How often each pass of cleaning edits the pages."""
    return html.planned(marked_pages(spark, sf_dir), policy.POLICY_TAG).groupBy("pass_no", "action", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(fx.FLAGS.sql()[1:-1])
def macro_flags(spark, sf_dir):
    """Macros by place and verdict, against the expected flags."""
    return html.macro_flags(fx.DIRTY.df(spark))


@query(fx.WARNED.sql()[1:-1])
def code_warnings(spark, sf_dir):
    """A row for each suspicious place of scripts, with its line, against the expected places."""
    return extract.code_warnings(fx.SCRIPTS.df(spark))


@query(r"SELECT page_id, regexp_replace(code, '//[#@][ \t]*sourceMappingURL\s*=\s*\S+', '', 'g') AS code FROM " + o.CODE_SCRIPTS)
def source_maps(spark, sf_dir):
    """Inline scripts without the comments that name their source maps."""
    return extract.inline_scripts(coded_pages(spark, sf_dir).select("page_id", "html")).select("page_id", extract.without_source_maps(F.col("body")).alias("code"))


@query(o.LIBRARY_BY_CODE)
def library_by_code(spark, sf_dir):
    """Libraries in the inline scripts of pages, by their code."""
    found = extract.inline_scripts(coded_pages(spark, sf_dir).select("page_id", "html")).select("page_id", extract.library_by_code(F.col("body")).alias("l"))
    return found.where("l IS NOT NULL").select("page_id", "l.lib", "l.version", "l.cdn_url")


@query(f"SELECT host, action FROM ({o.VERDICTS.format(rows='(SELECT DISTINCT host AS saved, ' + chr(39) + 'script' + chr(39) + ' AS kind, ' + chr(39) + 'https://' + chr(39) + ' || host || ' + chr(39) + '/' + chr(39) + ' AS url FROM (SELECT ' + o.host('url') + ' AS host FROM ' + o.RESOURCES + ') WHERE host IS NOT NULL)')})")
def external_folders(spark, sf_dir):
    """What becomes of the saved folder of each host that pages load from."""
    hosts = extract.resources(marked_pages(spark, sf_dir)).select(urls.host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    return hosts.select("host", extract.external_folder(F.col("host")).alias("action"))


@query()
def script_threats(spark, sf_dir):
    marked = marked_pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("main_host"), "html")
    return scripts.threats(extract.inline_scripts(marked, executable=True))


# ----------------------------------------------------------------- saved sites


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, site_id (host), rel_path, url, html: the pages as files of saved sites; of pages with one path the first."""
    rows = with_snippets(spark, sf_dir, fx.LINKED).withColumns({"site_id": urls.host(F.col("url")), "rel_path": F.regexp_replace(layout.local_path(F.col("url")), "^[^/]*/", "")})
    first = F.row_number().over(Window.partitionBy("site_id", "rel_path").orderBy("page_id"))
    return rows.withColumn("place", first).where("place = 1").select("page_id", "site_id", "rel_path", "url", "html")


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, rel_path, content: the pages and the fixture's files beside each, saved."""
    rows = site_pages(spark, sf_dir)
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    beside = rows.join(F.broadcast(fx.ASSETS.df(spark)), F.coalesce(F.pmod("page_id", F.lit(7)), F.lit(0)) == F.col("slot"))
    where = paths.in_site(F.replace(F.replace("path", F.lit("#"), number), F.lit(" "), F.lit("%20")), F.col("rel_path"))
    assets = beside.select("site_id", where.alias("rel_path"), F.replace("body", F.lit("#"), number).alias("content")).where("rel_path IS NOT NULL")
    assets = assets.groupBy("site_id", "rel_path").agg(F.min("content").alias("content"))
    return saved(rows.select("site_id", "rel_path", F.col("html").alias("content")).unionByName(assets), "site-files")


def main_files_of(files: DataFrame) -> DataFrame:
    return layout.main_files(files.withColumn("size", F.length("content").cast("long"))).select("site_id", "rel_path")


@query(f"SELECT page_id, raw, resolved FROM ({o.resolved(o.HREFS)})")
def resolved_urls(spark, sf_dir):
    """Every reference of every page as an absolute URL."""
    marked = with_snippets(spark, sf_dir, fx.LINKED)
    found = extract.resources(marked).select("page_id", F.col("url").alias("raw"))
    return paths.with_resolved(found.join(pages(spark, sf_dir).select("page_id", "url"), "page_id"), "raw", "url").select("page_id", "raw", "resolved")


@query(f"SELECT site_id, rel_path, {o.relative('rel_path', 'main')} AS way, {o.relative('main', 'rel_path')} AS back FROM (SELECT site_id, rel_path, min(rel_path) OVER (PARTITION BY site_id) AS main FROM {o.SITE_FILES})")
def relative_paths(spark, sf_dir):
    """The way from each file of a site to its first file, and back."""
    files = site_files(spark, sf_dir).select("site_id", "rel_path")
    firsts = files.groupBy("site_id").agg(F.min("rel_path").alias("main"))
    return files.join(firsts, "site_id").select("site_id", "rel_path", paths.relative(F.col("rel_path"), F.col("main")).alias("way"), paths.relative(F.col("main"), F.col("rel_path")).alias("back"))


@query(f"SELECT site_id, rel_path, raw FROM {o.references()}")
def site_references(spark, sf_dir):
    return sites.references(site_files(spark, sf_dir))


@query(f"SELECT site_id, rel_path, round, target FROM {o.MOVES}")
def moved_files(spark, sf_dir):
    """Which files move with the main files, through style sheets and circles of them."""
    files = site_files(spark, sf_dir)
    return sites.moved(files, saved(main_files_of(files), "main-files"), saved)


@query(o.RELOCATED)
def relocated_references(spark, sf_dir):
    """What the files load after the moves."""
    files = site_files(spark, sf_dir)
    main = saved(main_files_of(files), "main-files")
    return sites.references(sites.relocated(files, main, saved(sites.moved(files, main, saved), "moves")))


@query(o.REPAIRED)
def repaired_references(spark, sf_dir):
    return sites.repaired(site_files(spark, sf_dir))


@query(f"SELECT site_id, rel_path || ' | ' || outcome || ' | ' || raw || ' | ' || CASE outcome WHEN 'local-missing' THEN 'no such file in the site' ELSE 'no local copy: fetch by hand' END AS value FROM ({o.REPAIRED}) WHERE outcome IN ('local-missing', 'external-no-local')")
def missing_resources(spark, sf_dir):
    return sites.missing_report(sites.repaired(site_files(spark, sf_dir)))


@query(o.DELETED_COUNTS)
def deleted_references(spark, sf_dir):
    """How many elements each page loses with the files that cleaning deletes."""
    files = site_files(spark, sf_dir)
    return sites.without_deleted(files, files.where(F.contains("rel_path", F.lit("deleted"))).select("site_id", "rel_path")).select("site_id", "rel_path", "n_edits")


@query(o.FETCHED)
def fetched_assets(spark, sf_dir):
    """Assets that pages load and that aren't saved: what is asked for round by round, of a host that has the fixture's files."""
    files = site_files(spark, sf_dir)
    held = saved(site_pages(spark, sf_dir).select("site_id", "rel_path", F.col("html").alias("content"), "url", F.col("site_id").alias("main_host")), "held")
    had = files.where(~sites.is_html(F.col("rel_path"))).select(F.concat(F.lit("https://"), "site_id", F.lit("/"), F.replace("rel_path", F.lit(" "), F.lit("%20"))).alias("url"), F.col("content").alias("body"))
    both = had.unionByName(had.withColumn("url", F.replace("url", F.lit("https://"), F.lit("http://"))))
    return sites.fetched(held, held.select("site_id", "url"), both, saved, most=4)


OFFICIAL = fx.Fixture("cdn_url string, integrity string", [("https://code.jquery.com/jquery-3.6.1.min.js", "sha384-jq"), ("https://cdn.jsdelivr.net/npm/swiper@11.1.4/swiper-bundle.min.css", "sha384-sw"), ("https://cdnjs.cloudflare.com/ajax/libs/vue/3.2.1/vue.min.js", None), ("https://cdn.jsdelivr.net/npm/gsap@3.12.2/dist/gsap.min.js", "sha384-gs")])


@query(o.pinned(OFFICIAL))
def pinned_libraries(spark, sf_dir):
    """Local copies of libraries and what takes their place."""
    marked = with_snippets(spark, sf_dir, fx.LINKED)
    return html.pinned(marked, html.replacements(marked, OFFICIAL.df(spark))).select("page_id", F.inline("changes"))


@query(o.ALIASED)
def aliased_sinks(spark, sf_dir):
    """Calls of names that stand for what sends, in every script of every page."""
    rows = extract.inline_scripts(with_snippets(spark, sf_dir, fx.ALIASES).select("page_id", "html"))
    return scripts.aliased_calls(saved(rows, "scripts"), saved)


@query(o.SETTINGS)
def site_settings(spark, sf_dir):
    """Settings of a site for each page, from sound and broken files."""
    rows = pages(spark, sf_dir).join(F.broadcast(fx.CONFIGS.df(spark)), F.coalesce(F.pmod("page_id", F.lit(7)), F.lit(0)) == F.col("slot"))
    found = config.settings(rows.select("page_id", F.replace("markup", F.lit("#"), F.col("page_id").cast("string")).alias("content")))
    return found.select("page_id", F.array_join("problems", "; ").alias("problems"), "source", "default_vertical", "name_macro", F.col("verticals")["Adult"].alias("adult"), F.size("verticals").alias("n_verticals"))


LONGEST = 8_000


@query(f"SELECT page_id, 'markup' AS step, 'OverflowError' AS kind, 'more than {LONGEST} characters' AS message FROM pages WHERE length(html) > {LONGEST}")
def page_errors(spark, sf_dir):
    """The log of a cleaning that takes no page of over 8,000 characters."""
    return html.error_log(html.cleaned_or_error(pages(spark, sf_dir), policy.POLICY_TAG, LONGEST))


@query(f"SELECT page_id, reason, snippet FROM ({o.HELD})")
def held_nodes(spark, sf_dir):
    """What cleaning holds for review."""
    return html.held(marked_pages(spark, sf_dir), policy.POLICY_TAG).select("page_id", "reason", "snippet")


@query(f"SELECT reason, count(*) AS n, least(count(*), 100) AS n_shown, CASE WHEN count(*) > 100 THEN '... and ' || (count(*) - 100) || ' more' END AS note FROM ({o.VERDICTS.format(rows=o.RESOURCES)}) WHERE action <> 'keep' GROUP BY reason")
def change_sections(spark, sf_dir):
    return report.change_sections(extract.classified(marked_pages(spark, sf_dir)))


_SERVED = "regexp_matches(content, '(?is)<\\?php|<\\?=|<\\?(?:[^x]|x[^m])[^>]*\\?>|<%.*?%>')"


@query(f"SELECT site_id, rel_path, CASE WHEN e IN ('html', 'htm', 'php') THEN CASE WHEN {_SERVED} THEN 'server page' ELSE 'page' END WHEN e IN {o.values(policy.SERVER_EXTENSIONS)} THEN CASE WHEN {_SERVED} THEN 'server page' ELSE 'none' END WHEN e = 'css' THEN 'style' WHEN e IN ('js', 'mjs') THEN 'script' WHEN e = 'svg' THEN 'vector' WHEN e = 'map' THEN 'map' ELSE 'none' END AS route FROM (SELECT *, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS e FROM {o.SITE_FILES})")
def file_routes(spark, sf_dir):
    """What cleaning does with each file of the sites."""
    return sites.routed(site_files(spark, sf_dir))


@query(f"SELECT site_id, rel_path, percent, waits AS has_handlers, NOT waits AS is_dead FROM (SELECT site_id, rel_path, CAST(length(rel_path) % 3 AS DOUBLE) AS percent, regexp_matches(content, '\\.addEventListener\\s*\\(|(?:^|[^\\w$.])(?:jQuery|[$])\\s*\\(|\\.on[a-z]+\\s*=(?:[^=]|$)') AS waits FROM {o.SITE_FILES} WHERE ends_with(rel_path, '.js')) WHERE percent <= 1")
def dead_scripts(spark, sf_dir):
    """The verdict on scripts of the sites, with a coverage that follows from their paths."""
    files = site_files(spark, sf_dir).where(F.endswith("rel_path", F.lit(".js")))
    coverage = files.select("site_id", "rel_path", (F.length("rel_path") % 3).cast("double").alias("percent"))
    return report.dead_files(coverage, files)


@query(f"SELECT site_id, rel_path, replace(replace(replace(regexp_replace(content, ' xlink:href=\"[^\"]*\"', ''), ' onload=\"x()\"', ''), '<script>a</script>', ''), 'url(https://evil.test/s.png)', 'url(' || chr(39) || chr(39) || ')') AS cleaned FROM {o.SITE_FILES} WHERE ends_with(rel_path, '.svg')")
def cleaned_vectors(spark, sf_dir):
    files = site_files(spark, sf_dir).where(F.endswith("rel_path", F.lit(".svg")))
    return files.select("site_id", "rel_path", extract.svg_cleaned(F.col("content")).alias("cleaned"))


@query(f"SELECT 'image' AS part, element, attr, trigger, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM ({o.image_changes(TARGET, list(adapt.IMAGE_BASES.values()))}) GROUP BY ALL UNION ALL SELECT 'name', NULL, NULL, NULL, CAST(sum(n_replaced) AS BIGINT), count(*) FROM ({_NAME_COUNTS.replace('FROM pages', 'FROM ' + o.marked(fx.IMAGES))}) WHERE n_replaced > 0")
def adapt_summary(spark, sf_dir):
    """The report of adapting every page, images and names."""
    return adapt.adapt_report(adapt.adapted(with_snippets(spark, sf_dir, fx.IMAGES), TARGET, NAMES))


@query(f"SELECT w.site_id, from_path, url, f.rel_path FROM (SELECT site_id, rel_path AS from_path, raw AS url FROM ({o.REPAIRED}) WHERE outcome = 'by name') w JOIN {o.SITE_FILES} f ON w.site_id = f.site_id AND {o.basename('w.url')} = {o.basename('f.rel_path')} WHERE f.rel_path <> from_path QUALIFY row_number() OVER (PARTITION BY w.site_id, from_path, url ORDER BY starts_with(f.rel_path, '_external/'), length(f.rel_path), f.rel_path) = 1")
def candidate_pick(spark, sf_dir):
    """The file that each reference which leads nowhere is found as by its name alone, the shortest path first."""
    files = site_files(spark, sf_dir)
    lost = sites.repaired(files).where("outcome = 'by name'").select("site_id", F.col("rel_path").alias("from_path"), F.col("raw").alias("url"))
    return layout.candidates(files, lost)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, rel_path, content: the fixture's files of code beside each page."""
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    beside = pages(spark, sf_dir).join(F.broadcast(fx.CODE_FILES.df(spark)), F.coalesce(F.pmod("page_id", F.lit(7)), F.lit(0)) == F.col("slot"))
    return beside.select("page_id", F.replace("path", F.lit("#"), number).alias("rel_path"), F.replace("body", F.lit("#"), number).alias("content"))


@query(o.FILE_MACROS)
def file_macros(spark, sf_dir):
    """Macros in the strings of script files and in url() of style sheets."""
    return extract.file_macros(page_files(spark, sf_dir))


@query(f"SELECT page_id, rel_path, CASE WHEN is_map THEN 'deleted' WHEN plain <> content THEN 'stripped' ELSE 'kept' END AS outcome, CASE WHEN NOT is_map THEN plain END AS content FROM (SELECT *, regexp_matches(rel_path, '(?i)[.]map$') AS is_map, CASE WHEN regexp_matches(rel_path, '(?i)[.](js|mjs|css)$') THEN regexp_replace(regexp_replace(content, '//[#@][ \\t]*sourceMappingURL\\s*=\\s*\\S+', '', 'g'), '/\\*#[ \\t]*sourceMappingURL\\s*=\\s*[^*]*\\*/', '', 'g') ELSE content END AS plain FROM {o.PAGE_CODE})")
def source_map_files(spark, sf_dir):
    """Files without source maps: maps go, scripts and styles no longer name them."""
    return extract.unmapped(page_files(spark, sf_dir))


def pages_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_pages(spark, sf_dir).withColumn("site_id", urls.host(F.col("url")))


@query(o.site_stats(report.MEASURES))
def site_stats(spark, sf_dir):
    """Every counter of each site in one row."""
    return report.site_stats(pages_of_sites(spark, sf_dir).select("site_id", "html"))


@query(o.SITE_VERDICTS)
def site_verdicts(spark, sf_dir):
    """The line that a person reads about each site, its pages taken as recorded runs: calls of eval as errors, the share of code as difference."""
    found = pages_of_sites(spark, sf_dir)
    html = F.col("html")
    difference = 100.0 * (F.length(html) - F.length(extract.text_only(html))) / F.length(html)
    runs = found.select("site_id", F.col("page_id").alias("page"), F.when(F.col("page_id") % 2 == 0, "desktop").otherwise("mobile").alias("profile"), (F.length(html) > 0).alias("loaded"), F.regexp_count(html, F.lit(r"eval\(")).alias("n_errors"), difference.alias("difference"), F.lower(html).contains("quiz").alias("has_quiz"))
    asked = extract.resources(found.select(F.col("site_id").alias("page_id"), "html")).where("kind <> 'anchor'")
    return report.site_verdicts(runs, asked.select(F.col("page_id").alias("site_id"), "url"))


@query(o.FILE_CATEGORIES)
def file_categories(spark, sf_dir):
    """Files of each site by category."""
    return site_files(spark, sf_dir).groupBy("site_id", extract.file_category(F.col("rel_path")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT category, count(*) AS n FROM (SELECT CASE kind WHEN 'iframe' THEN 'html' WHEN 'stylesheet' THEN 'css' WHEN 'script' THEN 'js' WHEN 'img' THEN 'image' ELSE kind END AS category FROM ({o.RESOURCES})) GROUP BY category")
def request_categories(spark, sf_dir):
    """What pages load by category of the response; links, which load nothing, are of a kind of their own."""
    kind = F.col("kind")
    asked = F.when(kind == "iframe", "document").when(kind == "img", "image").otherwise(kind)
    return extract.resources(marked_pages(spark, sf_dir)).groupBy(extract.request_category(asked).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT site_id, rel_path, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN rel_path = 'index.html' THEN 0 ELSE 1 END, rel_path) AS place FROM {o.SITE_FILES} WHERE NOT contains(rel_path, '/') AND (ends_with(lower(rel_path), '.html') OR ends_with(lower(rel_path), '.htm'))")
def page_order(spark, sf_dir):
    """The order in which the pages at the top of each site are checked."""
    return report.page_order(site_files(spark, sf_dir))
