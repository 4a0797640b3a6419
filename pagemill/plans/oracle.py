"""Pieces of oracle SQL (DuckDB), written apart from the DataFrame code they check."""

from __future__ import annotations

from pagemill.functions import policy
from pagemill.plans import fixtures as fx


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def values(values: list[str]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def scheme(url: str) -> str:
    return f"lower(nullif(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1), ''))"


def host(url: str) -> str:
    return f"lower(nullif(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1), ''))"


def path(url: str) -> str:
    return f"regexp_extract(regexp_replace({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//[^/?#]*', ''), '^([^?#]*)', 1)"


def basename(url: str) -> str:
    return f"lower(regexp_extract(regexp_extract({url}, '^([^?#]*)', 1), '([^/]*)$', 1))"


def below(host: str, names: list[str]) -> str:
    return f"coalesce(len(list_filter({array(names)}, lambda t: {host} = t OR ends_with({host}, '.' || t))) > 0, false)"


def directory(name: str) -> str:
    known = " ".join(f"WHEN {{x}} IN {values(exts)} THEN {text(d)}" for d, exts in policy.DIRECTORIES.items())
    last, before = f"regexp_extract({basename(name)}, '\\.([a-z0-9]+)$', 1)", f"regexp_extract({basename(name)}, '\\.([a-z0-9]+)\\.[^.]*$', 1)"
    return f"coalesce(CASE {known.format(x=last)} END, CASE {known.format(x=before)} END, 'assets')"


def marked(snippets: fx.Fixture) -> str:
    """The pages with one of the seven snippets behind each, see catalog.with_snippets()."""
    return f"(SELECT page_id, url, coalesce(html, '') || replace(markup, '#', coalesce(CAST(page_id AS VARCHAR), '')) AS html FROM pages JOIN {snippets.sql()} ON coalesce((page_id % 7 + 7) % 7, 0) = slot)"


MARKED = marked(fx.SNIPPETS)
_RAW = ("script", "style", "textarea", "title", "noscript", "noframes", "iframe", "xmp")
#: An attribute as HTML has them, and a tag's attributes: white space, slashes or nothing between them.
_one = "[^\\s/>=][^\\s/>=]*(?:\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s\"''>][^\\s>]*))?"
_attrs = f"(?:[\\s/]+(?:{_one}[\\s/]*)*)?"
#: Markup without comments and without the content of elements whose content isn't markup.
_bare = "regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
for _tag in _RAW:
    _bare = f"regexp_replace({_bare}, '(?is)(<{_tag}{_attrs}>).*?(?:</{_tag}(?:[\\s/][^>]*)?>|\\z)', '\\1', 'g')"


def elements(tags: str, rows: str = MARKED, html: str = _bare) -> str:
    """page_id and the start tag of each element of the tags (a regular expression)."""
    return f"SELECT page_id, unnest(regexp_extract_all({html}, '(?is)<(?:{tags}){_attrs}>')) AS element FROM {rows}"


def value(name: str, element: str = "element") -> str:
    """Value of an attribute in double, single or no quotes, null without one."""
    at = f"(?i)[\\s/\"'']{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>][^\\s>]*))"
    raw = " || ".join(f"regexp_extract({element}, '{at}', {i})" for i in (1, 2, 3))
    plain = f"replace(replace(replace(replace(replace({raw}, '&quot;', '\"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"CASE WHEN regexp_matches({element}, '{at}') THEN {plain} END"


def attribute(tags: str, name: str, rows: str = MARKED) -> str:
    """page_id and value of an attribute of each element of the tags (a regular expression) that has it."""
    return f"SELECT * FROM (SELECT page_id, {value(name)} AS value FROM ({elements(tags, rows)})) WHERE value IS NOT NULL"


_kinds = [("script", "script", "src"), ("iframe", "iframe", "src"), ("img", "img", "src"), ("media", "video|audio|source", "src"), ("stylesheet", "link", "href"), ("anchor", "a|area", "href")]
RESOURCES = "(" + " UNION ALL ".join(f"SELECT page_id, '{kind}' AS kind, value AS url FROM ({attribute(tags, name)})" for kind, tags, name in _kinds) + ")"
ANCHORS = f"SELECT page_id, value AS href FROM ({attribute('a|area', 'href')})"
#: What hides scripts, and scripts: the leftmost of each is taken.
_blocks = "(?is)<!--.*?-->|" + "|".join(f"<{t}{_attrs}>.*?</{t}(?:[\\s/][^>]*)?>" for t in _RAW)
SCRIPTS = f"SELECT page_id, regexp_extract(block, '(?is)^(<script{_attrs}>)', 1) AS element, regexp_extract(block, '(?is)^<script{_attrs}>(.*)</script(?:[\\s/][^>]*)?>$', 1) AS body FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_blocks}')) AS block FROM {MARKED}) WHERE regexp_matches(block, '(?i)^<script[\\s/>]')"
INLINE = f"SELECT page_id, body FROM ({SCRIPTS}) WHERE {value('src')} IS NULL"
TRACKERS = [t for t in policy.TRACKER_HOSTS if "/" not in t]

_u = "regexp_replace(regexp_replace(coalesce(url, ''), '[\\t\\n\\r]', '', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_package = f"lower(CASE WHEN h = 'unpkg.com' THEN regexp_extract({path('u')}, '^/((?:@[^/]+/)?[^/@]+)', 1) ELSE regexp_extract({path('u')}, '(?i)^/npm/((?:@[^/]+/)?[^/@]+)', 1) END)"
_saved = "lower(regexp_extract(u, '(?i)(?:^|/)_external/([^/?#]+)', 1))"
_tracker = (
    f"(len(list_filter({array([t for t in policy.TRACKER_HOSTS if '/' in t])}, lambda t: contains(lower(u), t))) > 0 OR {below('h', TRACKERS)}"
    f" OR {below(_saved, TRACKERS)} OR len(list_filter({array(policy.TRACKER_FILES)}, lambda t: contains({basename('u')}, t))) > 0)"
)
_cases = f"""CASE WHEN u = '' THEN 'keep:empty' WHEN s = 'data' AND kind = 'img' THEN 'keep:inline image' WHEN s = 'blob' AND kind = 'media' THEN 'keep:inline media'
    WHEN s IN ('javascript', 'vbscript') AND kind = 'anchor' THEN 'remove:dangerous scheme' WHEN s IN {values(policy.DANGEROUS_SCHEMES)} THEN 'quarantine:dangerous scheme'
    WHEN NOT absolute THEN 'keep:relative' WHEN h IS NULL THEN 'quarantine:no host'
    WHEN ({below('h', policy.TRUSTED_LIB_HOSTS)} OR kind IN ('img', 'media') AND {below('h', policy.OWN_ASSET_HOSTS)}) AND h IN {values(policy.MULTITENANT_HOSTS)} AND kind IN {values(policy.PATH_CHECKED_KINDS)} AND NOT {_package} IN {values(policy.TRUSTED_PACKAGES)} THEN 'quarantine:other tenant'
    WHEN {below('h', policy.TRUSTED_LIB_HOSTS)} OR kind IN ('img', 'media') AND {below('h', policy.OWN_ASSET_HOSTS)} THEN 'keep:trusted host'
    WHEN {_tracker} THEN 'remove:tracker' ELSE 'quarantine:unlisted host' END"""
#: With `rows` (a subquery with kind and url): its columns, action, reason and host.
VERDICTS = (
    "SELECT * EXCLUDE (u, s, h, absolute, answer), split_part(answer, ':', 1) AS action, split_part(answer, ':', 2) AS reason, CASE WHEN absolute AND NOT coalesce(s IN @SCHEMES, false) THEN h END AS host"
    " FROM (SELECT *, @CASES AS answer FROM (SELECT *, @S AS s, @H AS h, regexp_matches(u, '(?i)^(https?:)?//') AS absolute FROM (SELECT *, @U AS u FROM @ROWS)))"
)
VERDICTS = VERDICTS.replace("@SCHEMES", values(policy.DANGEROUS_SCHEMES)).replace("@CASES", _cases).replace("@S", scheme("u")).replace("@H", host("u")).replace("@U", _u).replace("{", "{{").replace("}", "}}").replace("@ROWS", "{rows}")

_rels = "regexp_split_to_array(lower(trim(rel)), '\\s+')"
LINK_KIND = f"""CASE WHEN list_contains({_rels}, 'stylesheet') THEN 'stylesheet' WHEN list_contains({_rels}, 'modulepreload') THEN 'script'
    WHEN list_contains({_rels}, 'preload') OR list_contains({_rels}, 'prefetch') THEN CASE WHEN as_attr = 'script' THEN 'script' WHEN as_attr IN ('style', 'font') THEN 'stylesheet' WHEN as_attr = 'image' THEN 'img' WHEN as_attr IN ('video', 'audio', 'track') THEN 'media' WHEN as_attr IN ('document', 'iframe') THEN 'iframe' ELSE 'script' END
    WHEN list_contains({_rels}, 'preconnect') OR list_contains({_rels}, 'dns-prefetch') THEN 'preconnect' END"""

PAGE_FILES = f"(SELECT {host('url')} AS host, CASE WHEN name = '' THEN 'index' ELSE name END || '.html' AS rel_path, html AS content, length(html) AS size FROM (SELECT *, regexp_replace(regexp_replace({path('url')}, '^/', ''), '/$', '') AS name FROM pages))"


def main_score(rows: str) -> str:
    head = "left(content, 65536)"
    signals = [("(?i)<title[^>]*>[^<\\s][^<]*</title>", 30), ("(?i)<h1[\\s>]", 20), ("(?i)<form[\\s>]", 40), ("(?i)\\{offer\\}", 50)]
    there = " + ".join(f"CASE WHEN regexp_matches({head}, {text(p)}) THEN {s}e0 ELSE 0e0 END" for p, s in signals)
    return f"""SELECT *, CASE WHEN regexp_matches(rel_path, '(?i)(^|/)index\\.[^./]+$') THEN CASE WHEN regexp_matches(rel_path, '(?i)\\.(php[57s]?|phtml)$') THEN 900e0 ELSE 1000e0 END ELSE 0e0 END
        - 50e0 * (length(rel_path) - length(replace(rel_path, '/', ''))) + least(size / 200e0, 100e0) + ({there}) + 2e0 * len(regexp_extract_all({head}, '(?i)<(link|script|img|source|video|audio|iframe)[\\s>]')) AS score
        FROM {rows} WHERE regexp_matches(rel_path, '(?i)\\.(html?|xhtml|shtml|php[57s]?|phtml)$')"""


ISLANDS = "SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(end_pos) OVER (PARTITION BY file ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {rows})"

_version = "regexp_extract(url, '[@/\\-](\\d+\\.\\d+(?:\\.\\d+)?)(?:[/.\\-]|$)', 1)"
_libs = " UNION ALL ".join(f"SELECT {i} AS priority, {text(n)} AS lib, {text(p)} AS pattern, {text(t)} AS target" for i, (n, p, t) in enumerate(policy.LIBRARIES))
LIBRARIES = (f"SELECT case_id, arg_min(lib, priority) AS lib, {_version} AS version, arg_min(target, priority) AS target FROM @ROWS JOIN ({_libs}) ON regexp_matches({basename('url')}, pattern) WHERE {_version} <> '' GROUP BY case_id, url").replace("{", "{{").replace("}", "}}").replace("@ROWS", "{rows}")

_a = "regexp_replace(url, '(?i)&amp;', '&', 'g')"
IS_OFFER = f"""coalesce(regexp_matches({_a}, '(?i)^(https?:)?//') AND {host(_a)} IS NOT NULL AND CASE WHEN {host(_a)} = main_host OR ends_with({host(_a)}, '.' || main_host)
    THEN NOT regexp_matches({path(_a)}, '(?i)^/({"|".join(policy.INFO_PATHS)})(/|$)') AND NOT regexp_matches({path(_a)}, '(?i)^/wp-(content|admin|includes|json)/')
        AND (regexp_matches({_a}, '(?i)[?&]({"|".join(policy.OFFER_PARAMETERS)})') OR regexp_matches({_a}, '(?i)/({"|".join(policy.OFFER_PATHS)})/'))
    ELSE NOT {below(host(_a), policy.TRUSTED_LIB_HOSTS + policy.OWN_ASSET_HOSTS)} END, false)"""

_parts = f"list_filter(string_split({path('url')}, '/'), lambda s: s <> '' AND s <> '.' AND s <> '..')"
LOCAL_PATH = f"""{host('url')} || '/' || CASE WHEN len({_parts}) = 0 THEN 'index.html' WHEN ends_with({path('url')}, '/') THEN array_to_string({_parts}, '/') || '/index.html'
    WHEN NOT contains({_parts}[-1], '.') THEN array_to_string({_parts}, '/') || '/index.html' ELSE array_to_string({_parts}, '/') END"""


def _split(rows: str, tag: str, flag: str) -> str:
    """Rows of (page_id, piece and others) cut at the end of each element of the tag: what is in it, with its start tag as `flag`, and what is before it. For markup that is well formed and doesn't nest them."""
    cut = f"(SELECT * EXCLUDE (piece), unnest(regexp_split_to_array(piece, '</{tag}>')) AS piece, '(?is)^(.*)(<{tag}(?:\\s[^>]*)?>)(.*)$' AS there FROM {rows})"
    return f"(SELECT * EXCLUDE (piece, there), regexp_extract(piece, there, 2) AS {flag}, regexp_extract(piece, there, 3) AS piece FROM {cut} WHERE regexp_matches(piece, there) UNION ALL SELECT * EXCLUDE (piece, there), '' AS {flag}, CASE WHEN regexp_matches(piece, there) THEN regexp_extract(piece, there, 1) ELSE piece END AS piece FROM {cut})"


_MACROS = f"regexp_matches({{0}}, '\\{{{{[a-zA-Z0-9_:.\\-]+\\}}}}') AND NOT {{0}} LIKE '%{{{{_offer_value:offerimage}}}}%' AND {{0}} <> '{{{{offer}}}}'"
_images = array(policy.IMAGE_ATTRIBUTES)


def image_changes(target: str, bases: list[str]) -> str:
    """page_id, element, attr, before, trigger over the pages with the fixture of images: containment by cutting the markup at the ends of links and pictures."""
    asks = lambda v: f"coalesce({v} <> '' AND {v} <> {text(target)} AND ({_MACROS.format(v)} OR {v} IN {values(bases)}), false)"
    why = lambda v, more='': f"CASE WHEN {_MACROS.format(v)} THEN 'foreign-macro{more}' ELSE 're-point{more}' END"
    page = f"(SELECT page_id, regexp_replace({_bare}, '(?is)<!--.*?-->', '', 'g') AS piece FROM {marked(fx.IMAGES)})"
    pieces = f"(SELECT *, row_number() OVER () AS part FROM {_split(_split(page, 'a', 'link'), 'picture', 'picture')})"
    found = f"(SELECT * EXCLUDE (l), unnest(l) AS element, generate_subscripts(l, 1) AS place FROM (SELECT * EXCLUDE (piece), regexp_extract_all(piece, '(?is)<(?:img|source){_attrs}>') AS l FROM {pieces}))"
    hits = ", ".join(value(n) for n in policy.IMAGE_ATTRIBUTES)
    read = f"(SELECT *, starts_with(element, '<img') AS img, coalesce({value('src')}, '') AS src, list_filter([{hits}], lambda v: {asks('v')})[1] AS hit FROM {found})"
    names = f"concat_ws(' ', coalesce({value('src')}, {value('data-src')}, ''), {value('class')}, {value('id')}, {value('alt')})"
    tiny = " OR ".join(f"coalesce(TRY_CAST(nullif(regexp_extract({value(n)}, '^(\\d+)', 1), '') AS INTEGER) BETWEEN 1 AND 48, false)" for n in ("width", "height"))
    plain = f"(NOT regexp_matches({names}, {text(policy.NO_PRODUCT)}) AND NOT regexp_matches(coalesce({value('src')}, {value('data-src')}, ''), '(?i)\\.svg([?#]|$)') AND NOT ({tiny}))"
    # of a picture the first image has what its sources ask for
    ranked = f"(SELECT *, picture <> '' AND img AND row_number() OVER (PARTITION BY part, img ORDER BY place) = 1 AS first, bool_or(picture <> '' AND img) OVER (PARTITION BY part) AS shown, min_by(hit, place) FILTER (hit IS NOT NULL AND (NOT img)) OVER (PARTITION BY part) AS theirs, min(place) FILTER (hit IS NOT NULL AND NOT img) OVER (PARTITION BY part) AS their_place FROM {read})"
    chosen = f"(SELECT *, CASE WHEN regexp_matches(link, 'href=\"\\{{offer\\}}\"') AND {plain} THEN 'offer-anchor' WHEN first AND theirs IS NOT NULL AND (hit IS NULL OR their_place < place) THEN {why('theirs')} WHEN hit IS NOT NULL THEN {why('hit')} END AS trigger FROM {ranked})"
    before = lambda *n: "coalesce(" + ", ".join(f"nullif({value(x)}, '')" for x in n) + ", '')"
    imgs = f"SELECT page_id, 'img' AS element, 'src' AS attr, {before('src', 'data-src', 'srcset')} AS before, trigger FROM {chosen} WHERE img AND trigger IS NOT NULL AND src <> {text(target)}"
    sources = f"SELECT page_id, 'source', 'srcset', {before('srcset', 'data-srcset', 'src')}, {why('hit')} FROM {ranked} WHERE NOT img AND hit IS NOT NULL AND NOT shown AND coalesce({value('srcset')}, '') <> {text(target)}"
    style = f"(SELECT page_id, regexp_extract(element, '^<([a-z]+)', 1) AS tag, unnest(regexp_extract_all(coalesce({value('style')}, ''), '(?i)url\\(\\s*[''\"]?([^)''\"]*)[''\"]?\\s*\\)', 1)) AS u FROM ({elements('[a-z][^\\s/>]*', marked(fx.IMAGES))}))"
    return f"{imgs} UNION ALL {sources} UNION ALL SELECT page_id, tag, 'style', u, {why('u', '-bg')} FROM {style} WHERE {asks('u')}"


# ----------------------------------------------------------------- saved sites


def _stack(parts: str) -> str:
    """Segments after dots; '!' for each '..' above the root."""
    return f"list_reduce(list_transform({parts}, lambda s: [s]), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' AND (len(a) = 0 OR a[len(a)] = '!') THEN list_append(a, '!') WHEN s[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, s) END, CAST([] AS VARCHAR[]))"


def in_site(raw: str, from_file: str) -> str:
    named = f"url_decode(regexp_extract(trim({raw}), '^([^?#]*)', 1))"
    below = f"CASE WHEN starts_with({named}, '/') THEN {named} ELSE regexp_extract({from_file}, '^(.*)/[^/]*$', 1) || '/' || {named} END"
    kept = _stack(f"list_filter(string_split({below}, '/'), lambda s: s <> '')")
    return f"CASE WHEN {named} <> '' AND NOT list_contains({kept}, '!') THEN nullif(array_to_string({kept}, '/'), '') END"


def relative(from_file: str, to_file: str) -> str:
    here, there = (f"list_filter(string_split({p}, '/'), lambda s: s <> '')" for p in (f"regexp_extract({from_file}, '^(.*)/[^/]*$', 1)", to_file))
    n = f"len(list_filter(range(1, least(len({here}), len({there}) - 1) + 1), lambda i: ({here})[1:i] = ({there})[1:i]))"
    return f"repeat('../', len({here}) - {n}) || array_to_string(({there})[{n} + 1:], '/')"


_page_path = f"regexp_replace({LOCAL_PATH}, '^[^/]*/', '')"
_number = "coalesce(CAST(page_id AS VARCHAR), '')"
SITE_PAGES = f"(SELECT page_id, {host('url')} AS site_id, {_page_path} AS rel_path, url, html FROM {marked(fx.LINKED)} QUALIFY row_number() OVER (PARTITION BY {host('url')}, {_page_path} ORDER BY page_id) = 1)"
_asset_path = in_site(f"replace(replace(path, '#', {_number}), ' ', '%20')", "rel_path")
_assets = f"(SELECT site_id, {_asset_path} AS rel_path, replace(body, '#', {_number}) AS content FROM {SITE_PAGES} JOIN {fx.ASSETS.sql()} ON coalesce((page_id % 7 + 7) % 7, 0) = slot)"
SITE_FILES = f"(SELECT site_id, rel_path, html AS content FROM {SITE_PAGES} UNION ALL SELECT site_id, rel_path, min(content) FROM {_assets} WHERE rel_path IS NOT NULL GROUP BY ALL)"

_css_ref = "(?i)url\\(\\s*[''\"]?([^''\")]+)[''\"]?\\s*\\)"
_css_import = "(?i)@import\\s+[''\"]([^''\"]+)[''\"]"


def css_refs(css: str) -> str:
    return f"list_filter(list_transform(list_concat(regexp_extract_all({css}, '{_css_ref}', 1), regexp_extract_all({css}, '{_css_import}', 1)), lambda u: trim(u)), lambda u: u <> '' AND NOT starts_with(u, 'data:'))"


def references() -> str:
    """site_id, rel_path, raw of every file of the sites."""
    pages = f"(SELECT row_number() OVER () AS page_id, site_id, rel_path, content AS html FROM {SITE_FILES} WHERE regexp_matches(rel_path, '\\.(html?|xhtml|shtml|php[57s]?|phtml)$'))"
    # what is in a noscript counts as well
    html = _bare.replace("(<noscript", "(<nothing")
    asset = "|".join(policy.ASSET_TAGS)
    every = f"(SELECT site_id, rel_path, unnest(regexp_extract_all({html}, '(?is)<[a-z][^\\s/>]*{_attrs}>')) AS element, html FROM {pages})"
    is_asset = f"regexp_matches(element, '(?i)^<({asset})[\\s/>]')"
    plain = " UNION ALL ".join(f"SELECT site_id, rel_path, trim({value(n)}) AS raw FROM {every} WHERE {is_asset} AND {value(n)} IS NOT NULL" for n in ("href", "src", "data-src", "poster"))
    sets = f"SELECT site_id, rel_path, regexp_extract(trim(unnest(string_split({value('srcset')}, ','))), '^(\\S*)', 1) AS raw FROM {every} WHERE {is_asset} AND {value('srcset')} IS NOT NULL"
    styles = f"SELECT site_id, rel_path, unnest({css_refs(value('style'))}) AS raw FROM {every} WHERE {value('style')} IS NOT NULL"
    bodies = f"SELECT site_id, rel_path, unnest({css_refs('body')}) AS raw FROM (SELECT site_id, rel_path, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) AS body FROM {pages})"
    sheets = f"SELECT site_id, rel_path, unnest({css_refs('content')}) AS raw FROM {SITE_FILES} WHERE ends_with(rel_path, '.css')"
    return f"(SELECT DISTINCT * FROM ({plain} UNION ALL {sets} UNION ALL {styles} UNION ALL {bodies} UNION ALL {sheets}) WHERE trim(raw) <> '' AND NOT regexp_matches(raw, '^\\s*(data:|javascript:|#|mailto:|tel:|blob:)'))"


_relative_ref = "NOT regexp_matches(raw, '^\\s*([a-zA-Z][a-zA-Z0-9+.\\-]*:|/|#)')"
_LOCAL = f"(SELECT r.*, f.rel_path AS found FROM (SELECT *, {in_site('raw', 'rel_path')} AS means FROM {references()} WHERE {_relative_ref}) r JOIN {SITE_FILES} f ON f.site_id = r.site_id AND f.rel_path = r.means)"
MAIN_FILES = "(SELECT site_id, rel_path FROM (" + main_score(f"(SELECT site_id, rel_path, content, length(content) AS size FROM {SITE_FILES})") + ") QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY score DESC, rel_path) = 1)"
_css_loads = f"(SELECT site_id, rel_path, unnest({css_refs('content')}) AS raw FROM {SITE_FILES} WHERE ends_with(rel_path, '.css'))"
_name = "regexp_extract(rel_path, '([^/]*)$', 1)"
MOVES = f"""(WITH RECURSIVE main AS MATERIALIZED {MAIN_FILES}, files AS MATERIALIZED {SITE_FILES}, local AS MATERIALIZED {_LOCAL},
    loads AS MATERIALIZED (SELECT l.site_id, l.rel_path, f.rel_path AS found FROM (SELECT *, {in_site('raw', 'rel_path')} AS means FROM {_css_loads} WHERE {_relative_ref}) l JOIN files f ON f.site_id = l.site_id AND f.rel_path = l.means),
    m AS (SELECT DISTINCT site_id, found AS rel_path, 1 AS round FROM local SEMI JOIN main USING (site_id, rel_path)
        UNION SELECT l.site_id, l.found, m.round + 1 FROM m JOIN loads l ON l.site_id = m.site_id AND l.rel_path = m.rel_path WHERE m.round < 7),
    done AS (SELECT site_id, rel_path, CAST(min(round) AS INTEGER) AS round FROM m ANTI JOIN main USING (site_id, rel_path) GROUP BY ALL),
    placed AS (SELECT site_id, rel_path, round, {directory('rel_path')} AS dir, {_name} AS name FROM files LEFT JOIN done USING (site_id, rel_path)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id, dir, name ORDER BY (rel_path = dir || '/' || name) DESC, round, rel_path) - 1 AS place FROM placed WHERE round IS NOT NULL OR rel_path = dir || '/' || name)
    SELECT site_id, rel_path, round, dir || '/' || CASE WHEN place > 0 THEN regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '_' || place || regexp_extract(name, '(\\.[^.]*)$', 1) ELSE name END AS target FROM ranked WHERE round IS NOT NULL)"""
RELOCATED = f"""WITH t AS MATERIALIZED (SELECT site_id, rel_path, target FROM {MOVES} UNION ALL SELECT site_id, rel_path, 'index.html' FROM {MAIN_FILES}),
    n AS (SELECT l.site_id, l.rel_path, l.raw, {relative('h.target', 't.target')} || regexp_extract(l.raw, '^[^?#]*(.*)$', 1) AS new FROM {_LOCAL} l JOIN t h USING (site_id, rel_path) JOIN t ON t.site_id = l.site_id AND t.rel_path = l.found)
    SELECT DISTINCT r.site_id, coalesce(h.target, r.rel_path) AS rel_path, coalesce(n.new, r.raw) AS raw FROM {references()} r LEFT JOIN t h USING (site_id, rel_path) LEFT JOIN n ON n.site_id = r.site_id AND n.rel_path = r.rel_path AND n.raw = r.raw"""
_absolute = "regexp_matches(trim(raw), '(?i)^(https?:)?//')"
_last = f"CASE WHEN {_absolute} AND {path('trim(raw)')} IN ('', '/') THEN '' ELSE {basename('trim(raw)')} END"
REPAIRED = f"""WITH f AS MATERIALIZED (SELECT *, {basename('rel_path')} AS name FROM {SITE_FILES}),
    r AS MATERIALIZED (SELECT *, {_absolute} AS absolute, {_last} AS name, CASE WHEN NOT {_absolute} THEN {in_site('raw', 'rel_path')} END AS means FROM {references()}),
    c AS (SELECT r.site_id, r.rel_path, r.raw, {relative('r.rel_path', 'f.rel_path')} AS way, starts_with(f.rel_path, '_external/') AS ext, f.rel_path AS found FROM r JOIN f ON f.site_id = r.site_id AND f.name = r.name AND f.rel_path <> r.rel_path
        QUALIFY row_number() OVER (PARTITION BY r.site_id, r.rel_path, r.raw ORDER BY ext, length(way), found) = 1)
    SELECT r.site_id, r.rel_path, r.raw, CASE WHEN h.there IS NOT NULL OR NOT contains(r.name, '.') THEN 'kept' WHEN c.found IS NOT NULL THEN 'by name' WHEN absolute THEN 'external-no-local' ELSE 'local-missing' END AS outcome,
        CASE WHEN h.there IS NULL AND contains(r.name, '.') AND c.found IS NOT NULL THEN CASE WHEN starts_with(way, '.') THEN way ELSE './' || way END END AS new
    FROM r LEFT JOIN (SELECT site_id AS s, rel_path AS there FROM f) h ON h.s = r.site_id AND h.there = r.means LEFT JOIN c USING (site_id, rel_path, raw)"""


def resolved(rows: str) -> str:
    """The columns of `rows` (raw, base and others) with `resolved`."""
    u = f"(SELECT *, regexp_replace(regexp_extract({_u.replace('coalesce(url', 'coalesce(raw')}, '^([^#]*)', 1), '\\\\', '/', 'g') AS u, regexp_extract(base, '(?i)^(https?://[^/?#]+)', 1) AS origin, regexp_extract(base, '(?i)^https?://[^/?#]+([^?#]*)', 1) AS pth FROM {rows})"
    w = f"(SELECT *, CASE WHEN {scheme('u')} IS NOT NULL THEN u WHEN starts_with(u, '//') THEN {scheme('base')} || ':' || u WHEN starts_with(u, '/') THEN origin || u WHEN u = '' THEN regexp_extract(base, '^([^#]*)', 1) WHEN starts_with(u, '?') THEN origin || CASE pth WHEN '' THEN '/' ELSE pth END || u ELSE origin || CASE pth WHEN '' THEN '/' ELSE regexp_extract(pth, '^(.*/)', 1) END || u END AS whole FROM {u})"
    p = f"(SELECT *, regexp_extract(whole, '(?i)^https?://[^/?]*([^?]*)', 1) AS p, regexp_extract(whole, '(?i)^(https?)://([^/?]*)', 1) AS s, lower(regexp_extract(whole, '(?i)^(https?)://([^/?]*)', 2)) AS h, regexp_extract(whole, '(?i)^https?://[^?]*(.*)$', 1) AS q FROM {w})"
    parts = "string_split(p, '/')[2:]"
    kept = f"list_filter({_stack(parts)}, lambda s: s <> '!')"
    path_ = f"CASE WHEN p = '' THEN '/' ELSE '/' || array_to_string({kept}, '/') || CASE WHEN regexp_matches(p, '/\\.\\.?$') AND len({kept}) > 0 THEN '/' ELSE '' END END"
    return f"SELECT * EXCLUDE (u, origin, pth, whole, p, s, h, q), CASE WHEN regexp_matches(whole, '(?i)^https?:') THEN lower(s) || '://' || h || {path_} || q ELSE whole END AS resolved FROM {p}"


HREFS = f"(SELECT r.page_id, raw, url AS base FROM (" + " UNION ALL ".join(f"SELECT page_id, value AS raw FROM ({attribute(t, n, marked(fx.LINKED))})" for t, n in (("script|iframe|img|video|audio|source", "src"), ("link|a|area", "href"))) + ") r JOIN pages p ON p.page_id = r.page_id)"
DELETED_COUNTS = f"""WITH d AS (SELECT site_id, rel_path FROM {SITE_FILES} WHERE contains(rel_path, 'deleted')),
    e AS (SELECT page_id, {value('src')} AS raw FROM ({elements('script|img', marked(fx.LINKED))}) UNION ALL SELECT page_id, {value('href')} FROM ({elements('link', marked(fx.LINKED))})),
    h AS (SELECT p.site_id, p.rel_path, {in_site('raw', 'p.rel_path')} AS means FROM e JOIN {SITE_PAGES} p USING (page_id) WHERE raw IS NOT NULL AND NOT {_absolute} AND NOT contains(p.html, '<?php')),
    n AS (SELECT h.site_id, h.rel_path, count(*) AS n FROM h SEMI JOIN d ON d.site_id = h.site_id AND d.rel_path = h.means GROUP BY ALL)
    SELECT site_id, rel_path, CAST(coalesce(n, 0) AS BIGINT) AS n_edits FROM (SELECT site_id, rel_path FROM {SITE_FILES} WHERE regexp_matches(rel_path, '\\.(html?|xhtml|shtml|php[57s]?|phtml)$')) LEFT JOIN n USING (site_id, rel_path)"""


_local = f"regexp_replace({LOCAL_PATH.replace('url', 'u.url')}, '^[^/]*/', '')"
_wanted = f"regexp_matches(lower(rel_path), '\\.({'|'.join(policy.ASSET_EXTENSIONS)})$')"


def _asked(refs: str) -> str:
    """site_id and url of the own assets that rows (site_id, raw, base) load."""
    return f"SELECT DISTINCT site_id, resolved AS url FROM ({resolved(refs)}) WHERE regexp_matches(resolved, '^https?://') AND {host('resolved')} = site_id"


_first_base = f"(SELECT site_id, rel_path, min(v) AS href FROM (SELECT p.site_id, p.rel_path, {value('href')} AS v FROM ({elements('base', marked(fx.LINKED))}) JOIN {SITE_PAGES} p USING (page_id)) GROUP BY ALL)"
_page_refs = f"(SELECT r.site_id, r.raw, coalesce(b.resolved, p.url) AS base FROM {references()} r JOIN {SITE_PAGES} p USING (site_id, rel_path) LEFT JOIN (SELECT site_id, rel_path, resolved FROM ({resolved(f'(SELECT site_id, rel_path, href AS raw, url AS base FROM {_first_base} JOIN {SITE_PAGES} USING (site_id, rel_path))')})) b ON b.site_id = r.site_id AND b.rel_path = r.rel_path)"
_had = f"(SELECT s || '://' || site_id || '/' || replace(rel_path, ' ', '%20') AS url, content FROM {SITE_FILES}, (VALUES ('http'), ('https')) v(s) WHERE NOT regexp_matches(rel_path, '\\.(html?|xhtml|shtml|php[57s]?|phtml)$'))"


def _round(n: int, refs: str) -> str:
    before = "".join(f" ANTI JOIN {t} ON {t}.site_id = u.site_id AND {t}.url = u.url" for t in ("seen", *(f"a{i}" for i in range(1, n))))
    return f"r{n} AS MATERIALIZED ({_asked(refs)}), u{n} AS MATERIALIZED (SELECT u.* FROM r{n} u{before}), a{n} AS MATERIALIZED (SELECT u.site_id, u.url, {_local} AS rel_path, {n} AS round, h.content FROM u{n} u LEFT JOIN h ON h.url = u.url)"


_sheet_refs = "(SELECT site_id, unnest(" + css_refs("content") + ") AS raw, url AS base FROM a{n} WHERE ends_with(rel_path, '.css') AND content IS NOT NULL AND " + _wanted + ")"
FETCHED = f"WITH seen AS MATERIALIZED (SELECT site_id, url FROM {SITE_PAGES}), h AS MATERIALIZED {_had}, {_round(1, _page_refs)}"
for _n in (2, 3, 4):
    FETCHED += ", " + _round(_n, _sheet_refs.replace("{n}", str(_n - 1)))
FETCHED += " " + " UNION ALL ".join(f"SELECT site_id, url, rel_path, CAST(round AS INTEGER) AS round, content IS NOT NULL AS ok FROM a{i} WHERE {_wanted}" for i in (1, 2, 3, 4))


def pinned(official: fx.Fixture) -> str:
    """page_id, url, cdn_url, integrity of the local libraries of pages."""
    urls = f"(SELECT DISTINCT page_id, tag, url FROM (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, {value(n)} AS url FROM ({elements(t, marked(fx.LINKED))})" for t, n in (("script", "src"), ("link", "href"))) + ") WHERE url IS NOT NULL)"
    at = f"CASE WHEN regexp_matches(url, '(?i)^(https?:)?//') THEN {path('url')} WHEN starts_with({path('url')}, '/') THEN {path('url')} ELSE '/' || {path('url')} END"
    version = "(\\d+\\.\\d+(?:\\.\\d+)?(?:[-+.][0-9A-Za-z.]+)?)"
    by_path = f"CASE WHEN regexp_matches({at}, '(?i)^/ajax/libs/[^/]+/{version}/.+$') THEN 'https://cdnjs.cloudflare.com' || {at} WHEN regexp_matches({at}, '(?i)^/npm/(?:@[^/]+/)?[^/@]+@{version}/.+$') AND lower(regexp_extract({at}, '(?i)^/npm/((?:@[^/]+/)?[^/@]+)@', 1)) IN {values(policy.TRUSTED_PACKAGES)} THEN 'https://cdn.jsdelivr.net' || {at} END"
    known = f"(SELECT url, replace(target, '{{v}}', version) AS cdn_url FROM ({LIBRARIES.format(rows=f'(SELECT DISTINCT 1 AS case_id, url FROM {urls})').replace('SELECT case_id,', 'SELECT case_id, url,', 1)}))"
    judged = f"(SELECT * FROM ({VERDICTS.format(rows='(SELECT *, ' + chr(39) + 'script' + chr(39) + ' AS kind FROM ' + urls + ')')}) WHERE NOT (regexp_matches(url, '(?i)^(https?:)?//') AND action = 'keep'))"
    return f"SELECT page_id, j.url, o.cdn_url, o.integrity FROM (SELECT page_id, tag, j.url, coalesce(k.cdn_url, {by_path.replace('url', 'j.url')}) AS cdn_url FROM {judged} j LEFT JOIN {known} k ON k.url = j.url) j JOIN {official.sql()} o ON o.cdn_url = j.cdn_url"


# ------------------------------------------------------------- code of the pages

CODED = marked(fx.CODE)


def _raw_bodies(tag: str, rows: str) -> str:
    """page_id, the start tag and the content of each element of a raw tag."""
    return f"SELECT page_id, regexp_extract(block, '(?is)^(<{tag}{_attrs}>)', 1) AS element, regexp_extract(block, '(?is)^<{tag}{_attrs}>(.*)</{tag}(?:[\\s/][^>]*)?>$', 1) AS body FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_blocks}')) AS block FROM {rows}) WHERE regexp_matches(block, '(?i)^<{tag}[\\s/>]')"


CODE_SCRIPTS = f"(SELECT page_id, body AS code FROM ({_raw_bodies('script', CODED)}) WHERE {value('src')} IS NULL)"
CODE_STYLES = f"(SELECT page_id, body AS code FROM ({_raw_bodies('style', CODED)}))"
CODE_LINKS = f"(SELECT page_id, {value('rel')} AS rel, {value('as')} AS as_attr, {value('href')} AS href FROM ({elements('link', CODED)}))"
LIBRARY_BY_CODE = "SELECT page_id, arg_min(lib, priority) AS lib, arg_min(v, priority) AS version, arg_min(replace(target, '{v}', v), priority) AS cdn_url FROM (" + " UNION ALL ".join(f"SELECT page_id, code, {i} AS priority, {text(n)} AS lib, coalesce(nullif(regexp_extract(code, {text(v)}, 1) || regexp_extract(code, {text(v)}, 2), ''), {text(d)}) AS v, {text(t)} AS target FROM {CODE_SCRIPTS} WHERE regexp_matches(code, {text(p)})" for i, (n, p, v, d, t) in enumerate(policy.LIBRARY_CODE)) + ") GROUP BY page_id, code"
CODE_URLS = f"(SELECT page_id AS case_id, u AS url FROM (" + " UNION ALL ".join(f"SELECT page_id, {value(n)} AS u FROM ({elements(t, CODED)})" for t, n in (("script", "src"), ("link", "href"))) + ") WHERE u IS NOT NULL)"

_keep_host = f"({below('host', policy.TRUSTED_LIB_HOSTS)})"
_verdicts = lambda kind, tags, name: f"SELECT action FROM ({VERDICTS.format(rows='(SELECT value AS url, ' + text(kind) + ' AS kind FROM (' + attribute(tags, name) + '))')}) WHERE action <> 'keep'"
_own = f"x IN {values(policy.OWN_MACROS)}"
_macro = "'\\{[a-zA-Z0-9_:.\\-]+\\}'"
_link_rows = f"(SELECT href AS url, kind FROM (SELECT href, {LINK_KIND} AS kind FROM (SELECT {value('rel')} AS rel, {value('as')} AS as_attr, {value('href')} AS href FROM ({elements('link')}))) WHERE kind IS NOT NULL AND href IS NOT NULL)"
_css_foreign = f"len(list_filter({css_refs('body')}, lambda u: regexp_matches(u, '(?i)^(https?:)?//') AND NOT {below(host('u'), policy.TRUSTED_LIB_HOSTS)})) > 0"
_hrefs = f"(SELECT value AS v, regexp_matches(value, '(?i)^\\s*(javascript|vbscript|data|blob|filesystem):') AS dangerous, regexp_matches(value, '^\\s*\\{{[^}}]+\\}}\\s*$') AND len(list_filter(regexp_extract_all(value, {_macro}), lambda x: NOT {_own})) > 0 AS macro FROM ({attribute('a|area', 'href')}))"
_texts = f"(SELECT unnest(regexp_extract_all({_bare}, '>([^<]+)(?:<|$)', 1)) AS t FROM {MARKED})"
_handlers = " UNION ALL ".join(f"SELECT value FROM ({attribute('[a-z][^\\s/>]*', n)})" for n in ("onclick", "onload", "onerror"))
_keywords = f"len(list_filter({array(policy.INLINE_KEYWORDS)}, lambda k: contains({{0}}, k))) > 0"
_noscripts = f"(SELECT unnest(regexp_extract_all(html, '(?is)<noscript>(.*?)</noscript>', 1)) AS body FROM {MARKED})"
#: How often each pass edits the pages: what is there to edit, counted by expressions over the markup.
EDIT_COUNTS = " UNION ALL ".join(
    f"SELECT CAST({n} AS INTEGER) AS pass_no, {action} AS action, {text(reason)} AS reason, count(*) AS n FROM ({rows}) GROUP BY ALL"
    for n, action, reason, rows in [
        (1, "'remove'", "base", elements("base")),
        (3, "action", "script", _verdicts("script", "script", "src")),
        (4, "'remove'", "tracker data", f"SELECT 1 FROM ({SCRIPTS}) WHERE {value('type')} = 'application/ld+json' AND regexp_matches(body, '(?i)googletagmanager|google-analytics')"),
        (5, "'remove'", "inline tracker", f"SELECT 1 FROM ({SCRIPTS}) WHERE {value('src')} IS NULL AND coalesce({value('type')}, '') <> 'application/ld+json' AND {_keywords.format('body')}"),
        (6, "'quarantine'", "noscript", f"SELECT 1 FROM {_noscripts} WHERE regexp_matches(body, '^\\s*(<img src=\"//unlisted.test/[^\"]*\">\\s*)+$') UNION ALL SELECT 1 FROM {_noscripts} WHERE regexp_matches(body, '^[^<\\s]+<img src=\"//unlisted')"),
        (7, "'rewrite'", "style", f"SELECT 1 FROM ({_raw_bodies('style', MARKED)}) WHERE {_css_foreign}"),
        (8, "action", "link", f"SELECT action FROM ({VERDICTS.format(rows=_link_rows)}) WHERE action <> 'keep'"),
        (9, "'remove'", "verification", f"SELECT 1 FROM ({attribute('meta', 'name')}) WHERE lower(value) IN {values([m.lower() for m in policy.VERIFICATION_METAS])}"),
        (10, "'quarantine'", "refresh", f"SELECT 1 FROM ({attribute('meta', 'http-equiv')}) WHERE lower(value) = 'refresh'"),
        (11, "action", "iframe", _verdicts("iframe", "iframe", "src")),
        (12, "action", "img", _verdicts("img", "img", "src")),
        (13, "'quarantine'", "object", f"SELECT 1 FROM ({elements('object')}) UNION ALL {_verdicts('iframe', 'embed', 'src')}"),
        (14, "'remove'", "frame", elements("frame|frameset|noframes")),
        (15, "'quarantine'", "dangerous link", f"SELECT 1 FROM {_hrefs} WHERE dangerous"),
        (16, "'rewrite'", "offer link", f"SELECT 1 FROM {_hrefs} WHERE NOT dangerous AND NOT macro AND trim(v) <> '' AND NOT regexp_matches(trim(v), '(?i)^(#|mailto:|tel:)') AND NOT regexp_matches(trim(v), '^\\{{[a-zA-Z0-9_:.\\-]+\\}}$')"),
        (17, "'rewrite'", "foreign macro", f"SELECT 1 FROM {_hrefs} WHERE macro UNION ALL SELECT 1 FROM {_texts} WHERE len(list_filter(regexp_extract_all(t, {_macro}), lambda x: NOT {_own})) > 0"),
        (18, "'remove'", "event handler", f"SELECT 1 FROM ({_handlers}) WHERE regexp_matches(value, '(?i)https?://') OR {_keywords.format('value')}"),
        (19, "'insert'", "policy", "SELECT 1 FROM pages"),
    ]
)
REQUESTS = f"(SELECT 'p' || page_id AS page, CASE WHEN page_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS profile, url, false AS is_error FROM ({RESOURCES}) WHERE kind <> 'anchor')"
RANGES = "(SELECT 'f' || l_suppkey AS file, CAST(l_partkey % 500 AS INTEGER) AS start_pos, CAST(l_partkey % 500 + l_quantity AS INTEGER) AS end_pos, CAST(l_linenumber % 3 AS INTEGER) AS hits FROM lineitem)"
BRIEFS = "(SELECT page_id AS case_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Adult' WHEN 2 THEN ' WeightLoss ' ELSE 'None' END AS vertical, CASE page_id % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'file' ELSE 'macro' END AS image_mode, 'img/' || page_id || '.png' AS image_file FROM pages)"
SITE_SIZES = f"(SELECT site_id, rel_path, content, CAST(length(content) AS BIGINT) AS size FROM {SITE_FILES})"

_SCRIPTS_OF_ALIASES = f"(SELECT *, row_number() OVER () AS number FROM (SELECT page_id, body FROM ({_raw_bodies('script', marked(fx.ALIASES))}) WHERE {value('src')} IS NULL))"
_id = "[A-Za-z_$][\\w$]*"
ALIASED = f"""WITH RECURSIVE s AS MATERIALIZED {_SCRIPTS_OF_ALIASES},
    n AS MATERIALIZED (SELECT DISTINCT number, regexp_extract(m, '({_id})\\s*=', 1) AS name, regexp_extract(m, '=\\s*(?:(?:window|self|globalThis)\\.)?({_id}(?:\\.{_id})?)', 1) AS source FROM (SELECT number, unnest(regexp_extract_all(replace(replace(body, ';', ';;'), ',', ',,'), '(?:^|[^\\w$.])({_id}\\s*=\\s*(?:(?:window|self|globalThis)\\.)?{_id}(?:\\.{_id})?)\\s*(?:[;,\\n)}}]|$)', 1)) AS m FROM s)),
    d AS MATERIALIZED (SELECT DISTINCT number, unnest(regexp_extract_all(body, '\\b(?:function|class)\\s+({_id})', 1)) AS own FROM s),
    a AS (SELECT number, name, source AS sink FROM n WHERE source IN ('fetch', 'WebSocket', 'EventSource', 'navigator.serviceWorker', 'navigator.sendBeacon') AND NOT EXISTS (SELECT 1 FROM d WHERE d.number = n.number AND own = source)
        UNION SELECT n.number, n.name, a.sink FROM a JOIN n ON n.number = a.number AND n.source = a.name),
    c AS (SELECT page_id, number, regexp_extract(m, '^({_id})', 1) AS name, regexp_extract(m, '\\(\\s*["''`]([^"''`]+)', 1) AS target FROM (SELECT page_id, number, unnest(regexp_extract_all(body, '(?:^|[^\\w$.])({_id}(?:\\.register)?\\s*\\(\\s*["''`][^"''`]+["''`])', 1)) AS m FROM s))
    SELECT page_id, name, sink, target FROM c JOIN a USING (number, name) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.number = c.number AND own = name)"""
_config = f"(SELECT page_id, replace(markup, '#', CAST(page_id AS VARCHAR)) AS content FROM pages JOIN {fx.CONFIGS.sql()} ON coalesce((page_id % 7 + 7) % 7, 0) = slot)"
_kind = lambda p: f"json_type(content, '$.{p}')"
_told = f"""CASE WHEN NOT json_valid(content) THEN 'not JSON' WHEN json_type(content) <> 'OBJECT' THEN 'not an object' ELSE concat_ws('; ', CASE WHEN {_kind('defaultVertical')} <> 'VARCHAR' THEN 'defaultVertical: no text' END, CASE WHEN {_kind('nameMacro')} <> 'VARCHAR' OR content ->> '$.nameMacro' = '' THEN 'nameMacro: no text' END,
    CASE WHEN {_kind('verticals')} <> 'OBJECT' OR len(list_filter(json_keys(content, '$.verticals'), lambda k: coalesce(json_type(content, '$.verticals.' || k || '.imageBase') <> 'VARCHAR' OR content ->> ('$.verticals.' || k || '.imageBase') = '', true))) > 0 THEN 'verticals: no image bases' END) END"""
SETTINGS = f"""SELECT page_id, told AS problems, CASE WHEN told = '' THEN 'file' ELSE 'builtin' END AS source, coalesce(CASE WHEN told = '' THEN content ->> '$.defaultVertical' END, 'Adult') AS default_vertical, coalesce(CASE WHEN told = '' THEN content ->> '$.nameMacro' END, '{{_offer_value:offername}}') AS name_macro,
    coalesce(CASE WHEN told = '' THEN content ->> '$.verticals.Adult.imageBase' END, 'https://assets.example.com/Adult/{{_offer_value:offerimage}}') AS adult, CAST(2 + CASE WHEN told = '' THEN coalesce(len(list_filter(json_keys(content, '$.verticals'), lambda k: k NOT IN ('Adult', 'WeightLoss'))), 0) ELSE 0 END AS INTEGER) AS n_verticals FROM (SELECT *, {_told} AS told FROM {_config})"""

_whole = lambda tag: f"SELECT page_id, element || body || '</{tag}>' AS snippet, element FROM ({_raw_bodies(tag, MARKED)})"


def _held(kind: str, name: str, rows: str, reason: str) -> str:
    judged = VERDICTS.format(rows=f"(SELECT page_id, snippet, {value(name)} AS url, {text(kind)} AS kind FROM ({rows}))")
    return f"SELECT page_id, {text(reason)} AS reason, snippet FROM ({judged}) WHERE action = 'quarantine' AND url IS NOT NULL"


_plain = lambda tag: f"SELECT page_id, element AS snippet, element FROM ({elements(tag)})"
_held_links = f"SELECT page_id, 'link' AS reason, snippet FROM ({VERDICTS.format(rows=f'(SELECT page_id, snippet, href AS url, kind FROM (SELECT *, {LINK_KIND} AS kind FROM (SELECT page_id, element AS snippet, {value(chr(114) + chr(101) + chr(108))} AS rel, {value(chr(97) + chr(115))} AS as_attr, {value(chr(104) + chr(114) + chr(101) + chr(102))} AS href FROM ({elements(chr(108) + chr(105) + chr(110) + chr(107))}))) WHERE kind IS NOT NULL AND href IS NOT NULL)')}) WHERE action = 'quarantine'"
HELD = " UNION ALL ".join(
    [
        _held("script", "src", _whole("script"), "script"), _held("iframe", "src", _whole("iframe"), "iframe"), _held("img", "src", _plain("img"), "img"), _held("iframe", "src", _plain("embed"), "object"), _held_links,
        f"SELECT page_id, 'object', unnest(regexp_extract_all(html, '<object data=\"x\"></object>')) FROM {MARKED}",
        f"SELECT page_id, 'refresh', element FROM ({elements('meta')}) WHERE lower({value('http-equiv')}) = 'refresh'",
        f"SELECT page_id, 'noscript', unnest(list_concat(regexp_extract_all(html, '<noscript><img src=\"//unlisted[^>]*></noscript>'), list_transform(regexp_extract_all(html, '<noscript>text(<img src=\"//unlisted[^>]*>)</noscript>', 1), lambda x: x))) FROM {MARKED}",
        f"SELECT page_id, 'dangerous link', unnest(regexp_extract_all(html, ' href=\"javascript:[^\"]*\"')) FROM {MARKED}",
    ]
)

PAGE_CODE = f"(SELECT page_id, replace(path, '#', {_number}) AS rel_path, replace(body, '#', {_number}) AS content FROM pages JOIN {fx.CODE_FILES.sql()} ON coalesce((page_id % 7 + 7) % 7, 0) = slot)"
_strings = "list_transform(regexp_extract_all(content, '\"[^\"\\n]*\"|''[^''\\n]*''|`[^`]*`'), lambda x: CASE WHEN starts_with(x, '`') THEN regexp_replace(x, '\\$\\{[^}]*\\}', ' ', 'g') ELSE x END)"
_tokens = lambda texts: f"flatten(list_transform({texts}, lambda x: regexp_extract_all(x, {_macro})))"
_once = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_file_tokens = f"""(SELECT *, list_filter(l, lambda x: x IN {values(policy.OWN_MACROS)}) AS own, list_filter(l, lambda x: x NOT IN {values(policy.OWN_MACROS)}) AS theirs FROM (
    SELECT page_id, rel_path, true AS script, {_once.format('t')} AS l FROM (SELECT *, {_tokens(_strings)} AS t FROM {PAGE_CODE} WHERE regexp_matches(rel_path, '(?i)\\.m?js$'))
    UNION ALL SELECT page_id, rel_path, false, {_tokens("regexp_extract_all(content, '(?i)url[(][^)]*[)]')")} FROM {PAGE_CODE} WHERE regexp_matches(rel_path, '(?i)\\.css$')))"""
FILE_MACROS = f"""SELECT page_id, rel_path, kind, token, CASE WHEN script THEN 'script(external)' ELSE 'style(external)' END AS element, CASE WHEN script THEN '(js-string)' ELSE '(css-url)' END AS attr FROM (
    SELECT *, 'own' AS kind, unnest(own) AS token FROM {_file_tokens}
    UNION ALL SELECT *, CASE WHEN script THEN 'script' ELSE 'image' END, array_to_string({_once.format('theirs')}, ' ') FROM {_file_tokens} WHERE len(theirs) > 0)"""
_bare_text = "regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', '', 'g')"
_suspicious = text(policy.SUSPICIOUS)
_warnings = " + ".join(f"len(regexp_extract_all(body, {text(p)}))" for _, p in policy.JS_WARNINGS)
_measured = f"""SELECT page_id, 'pages' AS m, 1 AS n FROM {MARKED}
    UNION ALL SELECT page_id, 'server_pages', 1 FROM {MARKED} WHERE regexp_matches(html, '(?is)<\\?php|<\\?=|<\\?(?:[^x]|x[^m])[^>]*\\?>|<%.*?%>')
    UNION ALL SELECT page_id, 'inline_scripts', 1 FROM ({INLINE}) UNION ALL SELECT page_id, 'tracker_scripts', 1 FROM ({INLINE}) WHERE {_keywords.format('body')}
    UNION ALL SELECT page_id, 'suspicious_scripts', 1 FROM ({INLINE}) WHERE regexp_matches(body, {_suspicious}) UNION ALL SELECT page_id, 'script_warnings', {_warnings} FROM ({INLINE})
    UNION ALL SELECT page_id, CASE WHEN x IN {values(policy.OWN_MACROS)} THEN 'own_macros' ELSE 'foreign_macros' END, 1 FROM (SELECT page_id, unnest(regexp_extract_all({_bare_text}, {_macro})) AS x FROM {MARKED})
    UNION ALL SELECT page_id, kind || '_' || action, 1 FROM ({VERDICTS.format(rows=RESOURCES)})"""


def site_stats(measures: list[str]) -> str:
    counts = ", ".join(f"CAST(coalesce(sum(n) FILTER (m = {text(m)}), 0) AS BIGINT) AS {m}" for m in measures)
    return f"SELECT site_id, {counts} FROM ({_measured}) JOIN (SELECT page_id, {host('url')} AS site_id FROM pages) USING (page_id) GROUP BY site_id"


SITE_VERDICTS = f"""SELECT site_id, loaded AND n_foreign = 0 AND n_errors = 0 AS ok, concat_ws('; ', CASE WHEN NOT loaded THEN 'pages did NOT load, nothing is proven' END,
    CASE WHEN n_foreign = 0 THEN 'no requests to foreign hosts' ELSE n_foreign || ' FOREIGN hosts asked' END, 'pages: ' || n_pages || ', profiles: ' || profiles, CASE WHEN n_errors > 0 THEN n_errors || ' errors of scripts' END,
    'looks different by up to ' || printf('%.1f', round(difference, 1)) || '%' || CASE WHEN difference > {policy.VISUAL_LIMIT} THEN ', look at the layout' ELSE '' END, CASE WHEN quiz THEN 'has a quiz, click through it by hand' END) AS verdict
    FROM (SELECT {host('url')} AS site_id, bool_and(length(html) > 0) AS loaded, count(DISTINCT page_id) AS n_pages, CASE WHEN count(DISTINCT page_id % 2) = 2 THEN 'desktop+mobile' WHEN max(page_id % 2) = 0 THEN 'desktop' ELSE 'mobile' END AS profiles,
        CAST(sum(len(regexp_extract_all(html, 'eval\\('))) AS BIGINT) AS n_errors, max(100e0 * (length(html) - length({_bare_text})) / length(html)) AS difference, bool_or(contains(lower(html), 'quiz')) AS quiz FROM {MARKED} GROUP BY 1)
    JOIN (SELECT {host('p.url')} AS site_id, count(DISTINCT {host('r.url')}) FILTER (r.kind <> 'anchor' AND NOT {below(host('r.url'), policy.TRUSTED_LIB_HOSTS)}) AS n_foreign FROM pages p LEFT JOIN ({RESOURCES}) r USING (page_id) GROUP BY 1) USING (site_id)"""
_categories = " ".join(f"WHEN e IN {values(exts)} THEN {text(c)}" for c, exts in policy.FILE_CATEGORIES.items())
FILE_CATEGORIES = f"SELECT site_id, category, count(*) AS n FROM (SELECT site_id, CASE {_categories} ELSE 'other' END AS category FROM (SELECT site_id, lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) AS e FROM {SITE_FILES})) GROUP BY ALL"
