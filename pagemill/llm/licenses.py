"""Operator 8: licence scans by ordered signature rules, DataFrame operations only.

A text becomes its words (letters, digits and whatever is beyond ASCII; A-Z in lower case) with single spaces, so rules needn't
care for punctuation. A rule is a regular expression with a keyword that must be in the text before the expression is tried,
a priority (1: the surest), a label (the licence, with its version where the words have one) and a confidence. Each version is a
rule of its own, so that of "lgpl 2" and "lgpl 2 1 or later" the one with more words contains the other. Of detections that lie within one another, the outer one stays if
its priority is the same or better; the same words count for the better priority, then for the earlier rule.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common

#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licences: label, names (regular expressions over words), versions.
FAMILIES = [
    ("apache", ["apache (?:software )?licen[cs]e", "apache"], ["1 0", "1 1", "2 0", "2"]),
    ("lgpl", ["(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", ["(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl"], ["1 0", "3", "3 0"]),
    ("gpl", ["(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl"], ["1", "2", "2 0", "3", "3 0"]),
    ("mpl", ["mozilla public licen[cs]e", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public licen[cs]e", "epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution licen[cs]e", "cddl"], ["1 0", "1 1"]),
    ("eupl", ["european union public licen[cs]e", "eupl"], ["1 0", "1 1", "1 2"]),
    ("osl", ["open software licen[cs]e"], ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", ["academic free licen[cs]e"], ["1 2", "2 0", "2 1", "3 0"]),
    ("artistic", ["artistic licen[cs]e"], ["1 0", "2 0"]),
    ("boost", ["boost software licen[cs]e"], ["1 0"]),
    ("python", ["python software foundation licen[cs]e", "python licen[cs]e"], ["2", "2 0"]),
    ("gfdl", ["(?:gnu )?free documentation licen[cs]e", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("odbl", ["open (?:data commons )?database licen[cs]e", "odbl"], ["1 0"]),
    ("ofl", ["sil open font licen[cs]e", "open font licen[cs]e"], ["1 0", "1 1"]),
    ("cecill", ["cecill"], ["1 0", "1 1", "2 0", "2 1"]),
    ("zpl", ["zope public licen[cs]e"], ["1 1", "2 0", "2 1"]),
    ("mspl", ["microsoft public licen[cs]e", "ms pl"], []),
    ("msrl", ["microsoft reciprocal licen[cs]e", "ms rl"], []),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e"], []),
    ("bsd", ["(?:(?:2|3|4|two|three|four) clause )?bsd licen[cs]e", "(?:new|modified|simplified|revised|original) bsd licen[cs]e", "bsd (?:2|3|4|two|three|four) clause"], []),
    ("isc", ["isc licen[cs]e"], []),
    ("zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"], []),
    ("wtfpl", ["wtfpl"], ["2"]),
    ("unlicense", ["the unlicense", "unlicense"], []),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"]),
]
# Creative Commons terms: label, short words, long words.
COMMONS = [
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative|ative work)s?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative|ative work)s?"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
]
#: Families that grant later versions too.
LATER = ["lgpl", "agpl", "gpl", "gfdl"]
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Words of notices: label, regular expression, priority, confidence.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 1, 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty", 2, 0.7),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1, 0.95),
    ("lgpl", "under the terms of the gnu lesser general public licen[cs]e", 1, 0.95),
    ("apache", "you may not use this file except in compliance with the licen[cs]e", 1, 0.9),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e", 1, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1, 0.95),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 1, 0.9),
    ("public-domain", "(?:is|are) in the public domain", 2, 0.8),
    ("warranty", "without warranty of any kind", 3, 0.4),
    ("warranty", "without warranties or conditions of any kind", 3, 0.4),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*(?: by)?", 3, 0.4),
    ("copyright", "copyright by", 3, 0.3),
    ("copyright", "(?:protected by|subject to) copyright", 3, 0.4),
    ("copyright", "copyright holders?", 3, 0.3),
    ("reserved", "(?:all|some|no) rights reserved", 2, 0.6),
    ("reserved", "copyright (?:c )?(?:(?:19|20)[0-9]{2} )?all rights reserved", 1, 0.7),
    ("reserved", "may not be (?:reproduced|copied|redistributed|published)(?: or (?:reproduced|copied|redistributed|published))*(?: without)?(?: (?:prior|written|express))*(?: permission)?", 2, 0.6),
    ("reserved", "reproduction (?:in whole or in part )?(?:is )?(?:strictly )?prohibited", 2, 0.7),
    ("proprietary", "proprietary and confidential", 1, 0.9),
    ("proprietary", "confidential and proprietary", 1, 0.9),
    ("proprietary", "proprietary licen[cs]e", 1, 0.8),
    ("proprietary", "end user licen[cs]e agreement", 1, 0.8),
    ("proprietary", "for internal use only", 2, 0.6),
    ("non-commercial", "non ?commercial (?:use|purposes)(?: only)?", 2, 0.6),
    ("non-commercial", "for personal use only", 2, 0.5),
]
# Ways to grant: words before the name, priority, confidence.
GRANTS = [
    ("(?:licen[cs]ed|released|distributed|available|published|provided|made available) under (?:the )?(?:terms of )?(?:the )?", 1, 0.95),
    ("subject to (?:the )?(?:terms of )?(?:the )?", 1, 0.85),
    ("spdx licen[cs]e identifier ", 1, 0.99),
    ("", 2, 0.75),
]


def versioned(label: str, version: str) -> str:
    """A label with a version, whose words are its numbers: gpl and 3 give gpl-3.0."""
    return f"{label}-{'.'.join([*version.split(), '0'][:2])}"


def rules() -> list[dict]:
    """The rules in order: kw (a keyword with spaces around whole words), re, label, priority, conf."""
    found = []

    def add(kw: str, expression: str, label: str, priority: int, conf: float) -> None:
        found.append({"kw": kw, "re": f"( {expression})(?= )", "label": label, "priority": priority, "conf": conf})

    def keyword(expression: str) -> str:
        """The longest run of plain words of an expression."""
        plain, depth, run = [], 0, ""
        for i, c in enumerate(expression):
            depth += c == "("
            optional = expression[i + 1 : i + 2] in ("?", "*", "{")
            if depth or c in "[]?*{}|" or optional:
                plain.append(run)
                run = ""
            else:
                run += c
            depth -= c == ")"
        words = [w for p in [*plain, run] for w in [p.strip()] if w]
        best = max(words, key=len)
        return best

    for label, short, long in COMMONS:
        for grant, priority, conf in GRANTS:
            for version in COMMONS_VERSIONS:
                add("cc ", f"{grant}(?:a )?cc {short} {version}(?: international| unported| deed)?", versioned(label, version), priority, conf)
            add("cc ", f"{grant}(?:a )?cc {short}", label, priority + (not grant), conf - 0.1)
        for version in COMMONS_VERSIONS:
            add("creative commons", f"creative commons {long}(?: licen[cs]e)?(?: version)? {version}(?: international| unported)?(?: licen[cs]e)?", versioned(label, version), 1, 0.9)
        add("creative commons", f"creative commons {long}(?: international| unported)?(?: licen[cs]e)?", label, 1, 0.9)
    for label, names, versions in FAMILIES:
        for name in names:
            for grant, priority, conf in GRANTS:
                for version in versions:
                    numbered = f"{grant}{name}(?: version| v)? v?{version}"
                    add(keyword(name), f"{numbered}(?: only)?", versioned(label, version), priority, conf)
                    if label in LATER:
                        add(keyword(name), f"{numbered}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", f"{versioned(label, version)}-or-later", priority, conf)
                if len(name) > 6 or grant:
                    add(keyword(name), f"{grant}{name}", label, priority + (not grant), conf - 0.15)
    for label, expression, priority, conf in NOTICES:
        add(keyword(expression), expression, label, priority, conf)
    return found


RULE = "array<struct<kw string, re string, label string, priority int, conf double>>"
#: Before and after a detection; no word has them.
START, END = "\x01", "\x02"
#: What at least one rule or base phrase needs: one pass over the text leaves most texts out.
GATE = r" (?:licen[cs]e[ds]?|licen[cs]es|unlicense|copyright|rights reserved|cc by|cc0|creative commons|public domain|spdx|apache|lgpl|agpl|gpl|mpl|epl|cddl|eupl|gfdl|odbl|cecill|wtfpl|ms pl|ms rl|bsd|redistribution|permission|warranty|warranties|public|proprietary|confidential|prohibited|reproduced|copied|redistributed|published|unencumbered|commercial|noncommercial|personal use|internal use|foundation|charge) "


def words_spaced(text: Column) -> Column:
    """The text's words with one space before, between and after them; null and wordless texts: one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(norm: Column) -> Column:
    """Array of (start, stop (both word numbers), priority, id, label, conf) of all rules' detections in a text that passed the gate."""
    known = F.from_json(F.lit(json.dumps([{**r, "id": i} for i, r in enumerate(rules())])), RULE.replace("kw string", "id int, kw string"))
    tried = F.filter(known, lambda r: F.contains(norm, r["kw"]) & F.regexp_like(norm, r["re"]))

    def of(r: Column) -> Column:
        tokens = F.split(F.regexp_replace(norm, r["re"], f"{START}$1{END}"), " ")
        starts = F.filter(F.transform(tokens, lambda t, i: F.when(F.contains(t, F.lit(START)), i)), lambda i: i.isNotNull())
        stops = F.filter(F.transform(tokens, lambda t, i: F.when(F.contains(t, F.lit(END)), i - 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (-b).alias("minus_stop"), r["priority"].alias("priority"), r["id"].alias("id"), r["label"].alias("label"), r["conf"].alias("conf")))

    return F.array_sort(F.flatten(F.transform(tried, of)))


def verdict(found: Column) -> Column:
    """labels and doubt (the product of 1 - conf) of the detections that no other one suppresses: one pass in order of start, longest first, with the furthest stop of each priority so far."""
    none = F.lit(-1)
    zero = F.struct(none.alias("s1"), none.alias("s2"), none.alias("s3"), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("doubt"))

    def step(acc: Column, d: Column) -> Column:
        stop, p = -d["minus_stop"], d["priority"]
        reach = F.when(p == 1, acc["s1"]).when(p == 2, F.greatest(acc["s1"], acc["s2"])).otherwise(F.greatest(acc["s1"], acc["s2"], acc["s3"]))
        stays = stop > reach
        far = lambda n: F.when(p == n, F.greatest(acc[f"s{n}"], stop)).otherwise(acc[f"s{n}"]).alias(f"s{n}")
        return F.struct(far(1), far(2), far(3), F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"), F.when(stays, acc["doubt"] * (1 - d["conf"])).otherwise(acc["doubt"]).alias("doubt"))

    return F.aggregate(found, zero, step)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of `docs` (doc_id, text).

    Texts without words, null ones too, have no detections: empty labels and score 0. Rows are judged one by one, repeated
    ones alike.
    """
    rows = docs.select("doc_id", words_spaced(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", (spaces(F.col("norm")) - 1).cast("long").alias("n_words"), F.col("norm").rlike(GATE).alias("gate"))
    norm = F.when(F.col("gate"), F.col("norm"))
    rows = rows.select("doc_id", "n_words", norm.alias("norm")).withColumn("parts", F.struct(*[F.when(F.contains("norm", F.lit(f" {p} ")), F.split("norm", f" {p}(?= )")).alias(label) for p, label in BASE.items()]))
    part = {p: F.col(f"parts.`{label}`") for p, label in BASE.items()}
    n_base = sum((F.coalesce(F.size(x) - 1, F.lit(0)) for x in part.values()), F.lit(0)).cast("long")
    first = F.least(*[spaces(F.element_at(x, 1)) for x in part.values()]).cast("long")
    last = F.greatest(*[F.col("n_words") + 1 - spaces(F.element_at(x, -1)) - len(p.split()) for p, x in part.items()]).cast("long")
    base = F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(BASE[p])) for p, x in part.items()]))
    rows = rows.select("doc_id", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), base.alias("base"), F.when(F.col("norm").isNotNull(), detections(F.col("norm"))).alias("found"))
    rows = rows.withColumn("verdict", F.when(F.size("found") > 0, verdict(F.col("found"))))
    labels = F.array_union("base", F.coalesce("verdict.labels", F.array().cast("array<string>")))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(labels).alias("labels"), F.round(1 - F.coalesce("verdict.doubt", F.lit(1.0)), 12).alias("score"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_licenses": op8_licenses}
ORACLE_SQL: dict[str, str] = {}
