"""Files of a site: main file, directories, name clashes, candidates, local paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import policy, urls


def main_score(rel_path: Column, content: Column, size: Column) -> Column:
    """How much a file looks like the main page: index files first, less for depth, more for size, title, heading, form, offer macro and resources."""
    head = F.substring(content, 1, 65_536)
    php = rel_path.rlike(r"(?i)\.(php[57s]?|phtml)\z")
    index = F.when(rel_path.rlike(r"(?i)(^|/)index\.[^./]+\z"), F.when(php, 900.0).otherwise(1000.0)).otherwise(0.0)
    depth = (F.length(rel_path) - F.length(F.replace(rel_path, F.lit("/"), F.lit("")))).cast("double")
    signals = [(r"(?i)<title[^>]*>[^<\s][^<]*</title>", 30.0), (r"(?i)<h1[\s>]", 20.0), (r"(?i)<form[\s>]", 40.0), (r"(?i)\{offer\}", 50.0)]
    there = sum((F.when(head.rlike(p), s).otherwise(0.0) for p, s in signals), F.lit(0.0))
    loaded = F.regexp_count(head, F.lit(r"(?i)<(link|script|img|source|video|audio|iframe)[\s>]")).cast("double")
    return index - 50.0 * depth + F.least(size / 200.0, F.lit(100.0)) + there + 2.0 * loaded


def main_files(files: DataFrame, site: str = "site_id") -> DataFrame:
    """The best page of each site; equal scores go by path."""
    scored = files.where(F.col("rel_path").rlike(r"(?i)\.(html?|xhtml|shtml|php[57s]?|phtml)\z")).withColumn("score", main_score(F.col("rel_path"), F.col("content"), F.col("size")))
    best = Window.partitionBy(site).orderBy(F.desc("score"), "rel_path")
    return scored.withColumn("place", F.row_number().over(best)).where("place = 1").select(site, "rel_path", "score")


def directory(rel_path: Column) -> Column:
    """Directory for a file by its extension, by the one before where that is unknown, else assets."""
    known = F.create_map(*[F.lit(x) for d, exts in policy.DIRECTORIES.items() for e in exts for x in (e, d)])
    last = urls.extension(rel_path)
    before = F.regexp_extract(urls.basename(rel_path), r"\.([a-z0-9]+)\.[^.]*\z", 1)
    return F.coalesce(F.try_element_at(known, last), F.try_element_at(known, before), F.lit("assets"))


def placed(files: DataFrame) -> DataFrame:
    """site_id, rel_path, target: files in their directories, a number behind names that are taken there."""
    named = files.select("site_id", "rel_path", directory(F.col("rel_path")).alias("dir"), F.regexp_extract("rel_path", r"([^/]*)\z", 1).alias("name"))
    same = Window.partitionBy("site_id", "dir", "name").orderBy("rel_path")
    n = F.row_number().over(same) - 1
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?\z", 1), F.regexp_extract("name", r"(\.[^.]*)\z", 1)
    return named.select("site_id", "rel_path", F.concat("dir", F.lit("/"), F.when(n > 0, F.concat(stem, F.lit("_"), n.cast("string"), ext)).otherwise(F.col("name"))).alias("target"))


def candidates(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """case columns of `wanted` (site_id, from_path, url) with the file that its name is found as: own files before saved external ones, then the shortest path."""
    named = files.select("site_id", "rel_path", urls.basename(F.col("rel_path")).alias("name"))
    order = [F.col("rel_path").startswith("_external/"), F.length("rel_path"), F.col("rel_path")]
    # one of the best two of a name isn't the file that refers
    by_name = named.withColumn("best", F.row_number().over(Window.partitionBy("site_id", "name").orderBy(*order))).where("best <= 2").drop("best")
    pairs = wanted.withColumn("name", urls.basename(F.col("url"))).join(by_name, ["site_id", "name"]).where("rel_path <> from_path")
    first = Window.partitionBy("site_id", "from_path", "url").orderBy(*order)
    return pairs.withColumn("place", F.row_number().over(first)).where("place = 1").select("site_id", "from_path", "url", "rel_path")


def local_path(url: Column) -> Column:
    """Where a saved copy of a URL lies: host, path without dot segments, index.html for directories."""
    u = urls.normalized(url)
    parts = F.filter(F.split(urls.path(u), "/"), lambda s: (s != "") & ~s.isin(".", ".."))
    name = F.array_join(parts, "/")
    whole = F.when((name == "") | urls.path(u).endswith("/"), F.concat_ws("/", F.nullif(name, F.lit("")), F.lit("index.html"))).when(~F.element_at(parts, -1).contains("."), F.concat(name, F.lit("/index.html"))).otherwise(name)
    return F.concat_ws("/", urls.host(u), whole)
