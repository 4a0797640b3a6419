"""Threats in script code: where data may leave, pages may be left, keys may be read.

A shallow matcher: calls with literal addresses, and addresses joined from literals. It doesn't follow variables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import policy, urls

_LITERAL = r"""\s*["'`]([^"'`]+)["'`]"""
#: Threat, pattern whose group is an address (only foreign ones count), or a pattern without a group that always counts.
CALLS = [
    ("fetch", r"\bfetch\s*\(" + _LITERAL),
    ("websocket", r"new\s+WebSocket\s*\(" + _LITERAL),
    ("beacon", r"\bsendBeacon\s*\(" + _LITERAL),
    ("xhr", r"""\.open\s*\(\s*["'`][A-Za-z]+["'`]\s*,""" + _LITERAL),
    ("source", r"\.src\s*=" + _LITERAL),
    ("redirect", r"\blocation(?:\.href)?\s*=" + _LITERAL),
    ("redirect", r"\blocation\.(?:assign|replace)\s*\(" + _LITERAL),
]
FORMS = [
    ("service worker", r"serviceWorker\s*\.\s*register\s*\("),
    ("obfuscated eval", r"(?:\beval|\bFunction|setTimeout|setInterval)\s*\(\s*(?:atob|unescape|String\.fromCharCode)\s*\("),
    ("keylogger", r"""(?s)addEventListener\s*\(\s*["'`]key(?:down|up|press)["'`].*?(?:fetch|sendBeacon|XMLHttpRequest)"""),
    ("written script", r"""document\.write(?:ln)?\s*\(\s*["'`]<script"""),
]


def joined_literals(code: Column) -> Column:
    """The code with neighbouring string literals put together: "a" + "b" is "ab"."""
    return F.regexp_replace(code, r"""["'`]\s*\+\s*["'`]""", "")


def is_foreign(url: Column, main_host: Column) -> Column:
    h = urls.host(urls.normalized(url))
    own = F.coalesce(F.array_contains(urls.domains(h), main_host), F.lit(False))
    return h.isNotNull() & ~own & ~urls.in_domains(h, policy.TRUSTED_LIB_HOSTS)


def threats(scripts: DataFrame) -> DataFrame:
    """`scripts` (page_id, body, main_host) to page_id, threat, target (null for forms), one row for each find."""
    code = joined_literals(F.coalesce("body", F.lit("")))
    rows = scripts.select("page_id", "main_host", code.alias("code"))
    of = lambda name: lambda u: F.struct(F.lit(name).alias("threat"), u.alias("target"))
    calls = F.concat(*[F.transform(F.regexp_extract_all("code", F.lit(p), 1), of(t)) for t, p in CALLS])
    foreign = F.filter(calls, lambda c: is_foreign(c["target"], F.col("main_host")))
    forms = F.array_compact(F.array(*[F.when(F.col("code").rlike(p), F.struct(F.lit(t).alias("threat"), F.lit(None).cast("string").alias("target"))) for t, p in FORMS]))
    return rows.select("page_id", F.inline(F.concat(foreign, forms)))


# --------------------------------------------------------------------- aliases

#: Names of what sends or installs something; they may have the global object before them.
SINKS = ["fetch", "WebSocket", "EventSource", "navigator.serviceWorker", "navigator.sendBeacon"]
_NAME = r"[A-Za-z_$][\w$]*"
_ASSIGNED = rf"(?<![\w$.])({_NAME})\s*=\s*(?:(?:window|self|globalThis)\.)?({_NAME}(?:\.{_NAME})?)\s*(?=[;,\n)}}]|\z)"
_DECLARED = rf"\bfunction\s+({_NAME})|\bclass\s+({_NAME})"
_CALLED = rf"(?<![\w$.])({_NAME})(?:\.register)?\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"


def sink_aliases(scripts: DataFrame, saved, most: int = 20) -> DataFrame:
    """page_id, number, name, sink: the names that stand for a sink in each script of `scripts` (page_id, number, body): assigned to one, or to a name that stands for one, at any distance.

    Assignments are rows (script, name, name or sink); the closure grows round by round by a join on script and name, less
    what it has, so circles end. A name that the script declares as a function or class of its own stands for no sink.
    `saved` writes a table and reads it again. Scripts are told apart by page_id and number.
    """
    key = ["page_id", "number"]
    body = F.coalesce("body", F.lit(""))
    of = lambda pattern, *groups: F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), F.lit(g)).alias(str(g)) for g in groups])
    assigned = scripts.select(*key, F.explode(of(_ASSIGNED, 1, 2)).alias("x")).select(*key, F.col("x.1").alias("name"), F.col("x.2").alias("source")).where("name <> source").distinct()
    declared = scripts.select(*key, F.explode(of(_DECLARED, 1, 2)).alias("x")).select(*key, F.concat("x.1", "x.2").alias("own")).distinct()
    named = saved(assigned, "assigned")
    direct = named.where(F.col("source").isin(*SINKS)).join(declared.withColumnRenamed("own", "source"), [*key, "source"], "left_anti")
    frontier = found = saved(direct.select(*key, "name", F.col("source").alias("sink")).distinct(), "aliases-0")
    for n in range(1, most):
        steps = named.join(frontier.select(*key, F.col("name").alias("source"), "sink"), [*key, "source"]).select(*key, "name", "sink").distinct()
        frontier = saved(steps.join(found, [*key, "name", "sink"], "left_anti"), f"aliases-{n}")
        if frontier.isEmpty():
            break
        found = saved(found.unionByName(frontier), f"aliased-{n}")
    return found.join(declared.withColumnRenamed("own", "name"), [*key, "name"], "left_anti")


def aliased_calls(scripts: DataFrame, saved) -> DataFrame:
    """page_id, name, sink, target: calls with a literal address of names that stand for a sink, see sink_aliases()."""
    calls = F.arrays_zip(*[F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(_CALLED), F.lit(g)).alias(str(g)) for g in (1, 2)])
    rows = scripts.select("page_id", "number", F.explode(calls).alias("x")).select("page_id", "number", F.col("x.1").alias("name"), F.col("x.2").alias("target"))
    return rows.join(sink_aliases(scripts, saved), ["page_id", "number", "name"]).select("page_id", "name", "sink", "target")
