"""Settings for adaptation from JSON files: read permissively, checked, laid over the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import adapt

#: What a file may set, and the type of it.
SETTINGS = {"defaultVertical": "STRING", "nameMacro": "STRING", "verticals": "OBJECT"}
BUILTIN = {"default_vertical": "Adult", "name_macro": adapt.NAME_MACRO}


def problems(content: Column, parsed: Column) -> Column:
    """What is wrong with a file, as texts: it isn't JSON, not an object, or a setting isn't what it should be."""

    def wrong(name: str, kind: str) -> Column:
        own = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        if kind == "STRING":
            return F.when(own.isNotNull() & ((own != "STRING") | (F.try_variant_get(parsed, f"$.{name}", "string") == "") & (name == "nameMacro")), F.lit(f"{name}: no text"))
        each = F.map_values(F.try_variant_get(parsed, f"$.{name}", "map<string,variant>"))
        base = lambda x: F.coalesce((F.schema_of_variant(F.try_variant_get(x, "$.imageBase", "variant")) == "STRING") & (F.try_variant_get(x, "$.imageBase", "string") != ""), F.lit(False))
        return F.when(own.isNotNull() & (~own.startswith("OBJECT") | F.coalesce(F.exists(each, lambda x: ~base(x)), F.lit(False))), F.lit(f"{name}: no image bases"))

    found = F.array_compact(F.array(*[wrong(n, k) for n, k in SETTINGS.items()]))
    return F.when(content.isNull(), F.array().cast("array<string>")).when(parsed.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not an object"))).otherwise(found)


def settings(files: DataFrame) -> DataFrame:
    """The columns of `files` but content, and default_vertical, name_macro, verticals (map), source (file or builtin), problems (array) for each row, whose `content` is a JSON file's text or null.

    What a sound file sets lies over the built-in settings, the image bases of its verticals over theirs. A broken file, or one with a setting
    of another type, has no part in it: its problems are told, the rest of the rows isn't touched. Unknown settings are
    passed over; null is another type, an empty macro or base no text.
    """
    others = [c for c in files.columns if c != "content"]
    rows = files.withColumn("_parsed", F.try_parse_json("content")).withColumn("_wrong", problems(F.col("content"), F.col("_parsed")))
    sound = F.col("content").isNotNull() & (F.size("_wrong") == 0)
    value = lambda name, kind: F.when(sound, F.try_variant_get("_parsed", f"$.{name}", kind))
    own = F.create_map(*[F.lit(x) for pair in adapt.IMAGE_BASES.items() for x in pair])
    more = F.coalesce(F.transform_values(value("verticals", "map<string,variant>"), lambda k, v: F.try_variant_get(v, "$.imageBase", "string")), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more)
    return rows.select(*others, F.coalesce(value("defaultVertical", "string"), F.lit(BUILTIN["default_vertical"])).alias("default_vertical"), F.coalesce(value("nameMacro", "string"), F.lit(BUILTIN["name_macro"])).alias("name_macro"), merged.alias("verticals"), F.when(sound, "file").otherwise("builtin").alias("source"), F.col("_wrong").alias("problems"))
