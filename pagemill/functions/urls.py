"""Column functions over URLs, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import policy


def normalized(url: Column) -> Column:
    """As a browser reads an attribute: no tab, CR or LF anywhere, no control characters or spaces at the ends; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1), F.lit("")))


def is_absolute(url: Column) -> Column:
    return url.rlike(r"(?i)^(https?:)?//")


def host(url: Column) -> Column:
    """Host of an absolute or protocol-relative URL in lower case, else null. User names and ports are left out."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def path(url: Column) -> Column:
    """Path of an absolute URL, '/' where there is none; of a relative URL what stands before ? or #."""
    return F.regexp_extract(F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*", ""), r"^([^?#]*)", 1)


def basename(url: Column) -> Column:
    """What follows the last slash, up to ? or #, in lower case."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"([^/]*)\z", 1))


def extension(url: Column) -> Column:
    return F.regexp_extract(basename(url), r"\.([a-z0-9]+)\z", 1)


def domains(host: Column) -> Column:
    """The host and the domains above it: a.b.c, b.c, c. A suffix match becomes an equality."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_domains(host: Column, names: list[str]) -> Column:
    """Whether the host is one of the names or below one; false for null."""
    return F.coalesce(F.arrays_overlap(domains(host), F.array(*map(F.lit, names))), F.lit(False))


def tracker_file(url: Column) -> Column:
    return basename(url).rlike("|".join(f.replace(".", r"\.") for f in policy.TRACKER_FILES))


def is_tracker(url: Column) -> Column:
    """By a path of a tracker, its host, its host in a saved _external folder, or its file name."""
    paths = "|".join(t.replace(".", r"\.") for t in policy.TRACKER_HOSTS if "/" in t)
    names = [t for t in policy.TRACKER_HOSTS if "/" not in t]
    saved = F.lower(F.nullif(F.regexp_extract(url, r"(?i)(?:^|/)_external/([^/?#]+)", 1), F.lit("")))
    return F.lower(url).rlike(paths) | (is_absolute(url) & in_domains(host(url), names)) | in_domains(saved, names) | tracker_file(url)


def package(url: Column) -> Column:
    """Package that a path of a multi-tenant host names, null where it names none."""
    at = path(url)
    named = F.when(host(url) == "unpkg.com", F.regexp_extract(at, r"^/((?:@[^/]+/)?[^/@]+)", 1)).otherwise(F.regexp_extract(at, r"(?i)^/npm/((?:@[^/]+/)?[^/@]+)", 1))
    return F.lower(F.nullif(named, F.lit("")))


def verdict(url: Column, kind: Column) -> Column:
    """STRUCT<action, reason, host> for a resource: keep, remove or quarantine. Whatever no list names is quarantined."""
    u = normalized(url)
    return _verdict(u, scheme(u), host(u), kind)


def with_verdict(rows: DataFrame, url: str, kind: str) -> DataFrame:
    """`rows` with action, reason and host; each part of the URL is taken once for a row."""
    parts = rows.withColumn("_u", normalized(F.col(url))).withColumns({"_s": scheme(F.col("_u")), "_h": host(F.col("_u"))})
    judged = parts.withColumn("_v", _verdict(F.col("_u"), F.col("_s"), F.col("_h"), F.col(kind)))
    return judged.select(*rows.columns, "_v.action", "_v.reason", "_v.host")


def _verdict(u: Column, s: Column, h: Column, kind: Column) -> Column:
    answer = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    trusted = in_domains(h, policy.TRUSTED_LIB_HOSTS) | (kind.isin("img", "media") & in_domains(h, policy.OWN_ASSET_HOSTS))
    other_tenant = h.isin(*policy.MULTITENANT_HOSTS) & kind.isin(*policy.PATH_CHECKED_KINDS) & ~F.coalesce(package(u).isin(*policy.TRUSTED_PACKAGES), F.lit(False))
    chosen = (
        F.when(u == "", answer("keep", "empty"))
        .when(s.isin(*policy.DANGEROUS_SCHEMES) & (s == "data") & (kind == "img"), answer("keep", "inline image"))
        .when(s.isin(*policy.DANGEROUS_SCHEMES) & (s == "blob") & (kind == "media"), answer("keep", "inline media"))
        .when(s.isin("javascript", "vbscript") & (kind == "anchor"), answer("remove", "dangerous scheme"))
        .when(s.isin(*policy.DANGEROUS_SCHEMES), answer("quarantine", "dangerous scheme"))
        .when(~is_absolute(u), answer("keep", "relative"))
        .when(h.isNull(), answer("quarantine", "no host"))
        .when(trusted & other_tenant, answer("quarantine", "other tenant"))
        .when(trusted, answer("keep", "trusted host"))
        .when(is_tracker(u), answer("remove", "tracker"))
        .otherwise(answer("quarantine", "unlisted host"))
    )
    shown = F.when(is_absolute(u) & ~F.coalesce(s.isin(*policy.DANGEROUS_SCHEMES), F.lit(False)), h)
    return F.struct(chosen["action"].alias("action"), chosen["reason"].alias("reason"), shown.alias("host"))
