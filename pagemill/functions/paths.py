"""Column functions over paths and references, all inside the JVM: dot segments, resolving and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls


def _stacked(parts: Column) -> Column:
    """Segments with '.' gone and '..' having taken the one before along; above counts the '..' that found none."""
    start = F.struct(F.slice(parts, 1, 0).alias("kept"), F.lit(0).alias("above"))

    def step(acc: Column, part: Column) -> Column:
        kept, above = acc["kept"], acc["above"]
        up = F.struct(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))).alias("kept"), F.when(F.size(kept) == 0, above + 1).otherwise(above).alias("above"))
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.struct(F.concat(kept, F.array(part)).alias("kept"), above.alias("above")))

    return F.aggregate(parts, start, step)


def folded(path: Column) -> Column:
    """A URL's path without dot segments: what would lead above the root stays at it, a last '.' or '..' leaves a slash."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    body = F.when(F.startswith(path, F.lit("/")), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(_stacked(body)["kept"], "/"))


def with_resolved(rows: DataFrame, raw: str, base: str, name: str = "resolved") -> DataFrame:
    """`rows` with the reference `raw` as an absolute URL without its fragment, as a browser on the page `base` takes it; null where the base is no http(s) URL and the reference needs one.

    Dot segments are folded, a backslash counts as a slash, hosts are in lower case and without the scheme's own port.
    Characters stay as they are written, percent signs or not. Other schemes' references come back as they are.
    """
    web = r"(?is)^(https?):/*([^/?]*)([^?]*)(.*)\z"
    u, b, at, whole = (F.col(c) for c in ("_u", "_b", "_at", "_whole"))
    plain = rows.withColumn("_u", F.regexp_extract(urls.normalized(F.col(raw)), r"^([^#]*)", 1)).withColumn("_b", F.regexp_extract(urls.normalized(F.col(base)), r"^([^#]*)", 1))
    slashed = plain.withColumn("_u", F.concat(F.replace(F.regexp_extract(u, r"^([^?]*)", 1), F.lit("\\"), F.lit("/")), F.regexp_extract(u, r"(?s)^[^?]*(.*)\z", 1)))
    split = slashed.withColumns({"_origin": F.nullif(F.regexp_extract(b, r"(?i)^(https?://[^/?]+)", 1), F.lit("")), "_at": F.regexp_extract(b, r"(?i)^https?://[^/?]+([^?]*)", 1), "_own": urls.scheme(u)})
    joined = split.withColumn(
        "_whole",
        F.when(F.col("_own").isNotNull(), u)
        .when(F.col("_origin").isNull(), F.lit(None))
        .when(F.startswith(u, F.lit("//")), F.concat(urls.scheme(b), F.lit(":"), u))
        .when(F.startswith(u, F.lit("/")), F.concat("_origin", u))
        .when(u == "", b)
        .when(F.startswith(u, F.lit("?")), F.concat("_origin", F.when(at == "", F.lit("/")).otherwise(at), u))
        .otherwise(F.concat("_origin", F.when(at == "", F.lit("/")).otherwise(F.regexp_extract(at, r"^(.*/)", 1)), u)),
    )
    parted = joined.withColumns({c: F.regexp_extract(whole, web, i) for c, i in (("_scheme", 1), ("_host", 2), ("_path", 3), ("_query", 4))})
    host = F.regexp_replace(F.lower("_host"), F.when(F.lower("_scheme") == "https", F.lit(r":(443)?$")).otherwise(F.lit(r":(80)?$")), F.lit(""))
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(folded(F.col("_path")))
    done = F.when(whole.rlike("(?i)^https?:"), F.when(F.col("_host") != "", F.concat(F.lower("_scheme"), F.lit("://"), host, path, "_query"))).otherwise(whole)
    return parted.withColumn("_done", done).drop("_u", "_b", "_origin", "_at", "_own", "_whole", "_scheme", "_host", "_path", "_query").withColumnRenamed("_done", name)


def directory(path: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def in_site(raw: Column, from_file: Column) -> Column:
    """Which file of its site a relative reference of `from_file` means: query and fragment cut, percent signs decoded where they can be, from the site's root if it starts with a slash; null for none or one outside the site."""
    named = F.regexp_extract(F.trim(raw), r"^([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))), named)
    below = F.when(F.startswith(decoded, F.lit("/")), decoded).otherwise(F.concat(directory(from_file), F.lit("/"), decoded))
    done = _stacked(F.filter(F.split(below, "/"), lambda p: p != ""))
    return F.when((named != "") & (done["above"] == 0), F.nullif(F.array_join(done["kept"], "/"), F.lit("")))


def relative(from_file: Column, to_file: Column) -> Column:
    """The way from the folder of one file of a site to another file: '../' for each folder to leave, then what follows the common ones."""
    here, there = (F.filter(F.split(p, "/"), lambda x: x != "") for p in (directory(from_file), to_file))
    shared = F.aggregate(F.sequence(F.lit(0), F.size(here)), F.lit(0), lambda n, i: F.when((i > 0) & (n == i - 1) & (F.get(here, i - 1) == F.get(there, i - 1)), n + 1).otherwise(n))
    n = F.least(shared, F.size(there) - 1)
    return F.concat(F.repeat(F.lit("../"), F.size(here) - n), F.array_join(F.slice(there, n + 1, F.size(there)), "/"))


def shown(from_file: Column, to_file: Column) -> Column:
    """relative() as a reference: with './' where it doesn't start with a dot."""
    way = relative(from_file, to_file)
    return F.when(F.startswith(way, F.lit(".")), way).otherwise(F.concat(F.lit("./"), way))


def is_relative(raw: Column) -> Column:
    """Whether a reference is relative to its page: no scheme, host, fragment alone or path from the root."""
    return (F.trim(raw) != "") & ~raw.rlike(r"^\s*([a-zA-Z][a-zA-Z0-9+.\-]*:|/|#)")


def is_skipped(raw: Column) -> Column:
    """Whether a reference loads nothing from anywhere."""
    return (F.trim(raw) == "") | raw.rlike(r"^\s*(data:|javascript:|#|mailto:|tel:|blob:)")
