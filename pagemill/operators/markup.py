"""Where elements, attributes and texts stand in markup, and edits put into it."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagemill.sources import batches as small

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\t\n\f\r />]*)|[!?/])")
_COMMENT = re.compile(r"-?>|.*?--!?>", re.S)
_GAP = re.compile(r"[\t\n\f\r /]*")
_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
#: Python reads no decimal number of over 4,300 digits; nine of them say as well that it is no character.
_LONG_NUMBER = re.compile(r"&#([0-9]{100,})")
#: Elements whose content isn't markup, and elements without content.
RAW = {"script", "style", "textarea", "title", "noscript", "noframes", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}
#: What is looked for in a noscript, whose content browsers take as text.
FALLBACKS = {"script", "iframe", "img"}
ATTRIBUTE = "struct<name:string,value:string,start:int,stop:int>"
#: tag "#text": a run of text that isn't blank; within: the element around it, or "noscript"; number: place in the document; up: the number of the element around it, -1 without one.
ELEMENT = f"struct<tag:string,start:int,inner:int,stop:int,body:string,within:string,attrs:array<{ATTRIBUTE}>,number:int,up:int>"
_ARROW_ATTRIBUTE = pa.struct([("name", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_ARROW = pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int32()), ("inner", pa.int32()), ("stop", pa.int32()), ("body", pa.string()), ("within", pa.string()), ("attrs", pa.list_(_ARROW_ATTRIBUTE)), ("number", pa.int32()), ("up", pa.int32())]))


def unescaped(value: str) -> str:
    """The value with its character references resolved, however long their numbers are."""
    if "&#" in value:
        value = _LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:9] or "0"), value)
    return entities.unescape(value)


def attributes_of(text: str, at: int) -> tuple[list[dict], int] | None:
    """The attributes of a tag from behind its name on, and where it ends; None if the document ends in it.

    As browsers read them: white space, slashes or nothing stand between attributes, a value without quotes goes on to
    white space or the tag's end, whatever quotes are in it. An attribute starts where the one before stops.
    """
    found = []
    while True:
        start, at = at, _GAP.match(text, at).end()
        if at >= len(text):
            return None
        if text[at] == ">":
            return found, at + 1
        name = _NAME.match(text, at)
        at, value = name.end(), ""
        if m := _EQUALS.match(text, at):
            at = m.end()
            if text[at : at + 1] in ("'", '"'):
                stop = text.find(text[at], at + 1)
                if stop < 0:
                    return None
                value, at = text[at + 1 : stop], stop + 1
            else:
                m = _BARE.match(text, at)
                value, at = m[0], m.end()
        found.append({"name": name[0].lower(), "value": unescaped(value), "start": start, "stop": at})


def elements_of(text: str, tags: Collection[str] | None = None, names: Collection[str] | None = None, bare: bool = True, nested: bool = False) -> list[dict]:
    """Every element and text of a document: tag, where it starts, where its content starts, where it stops (offsets in characters), the content of raw elements and texts, attributes, its number and that of the element around it.

    An element that isn't closed stops with its tag. Comments, declarations and a tag in which the document ends are no
    markup. `tags` and `names` leave out other elements and attributes; texts that are left out have no number. Without
    `bare`, texts are left out too, and so are elements without an attribute of `names`, but for styles. Of a noscript, `body`
    is what its content has besides FALLBACKS, which follow it as elements of their own; in that content (`nested`) further
    noscripts, which have no end there, are passed over. No character is looked at more than a few times, whatever the markup.
    """
    found: list[dict] = []
    opened: list[dict] = []
    open_tags: Counter[str] = Counter()
    at = number = 0
    wanted = lambda tag: tags is None or tag in tags

    def add(tag: str, start: int, inner: int, stop: int, body: str | None, attrs: list[dict], up: dict | None) -> dict:
        nonlocal number
        if names is not None:
            attrs = [a for a in attrs if a["name"] in names]
        e = {"tag": tag, "start": start, "inner": inner, "stop": stop, "body": body, "within": up["tag"] if up else "", "attrs": attrs, "number": number, "up": up["number"] if up else -1}
        number += 1
        if wanted(tag) and (bare or attrs or tag == "style"):
            found.append(e)
        return e

    def plain(start: int, stop: int, up: dict | None) -> None:
        if bare and wanted("#text") and start < stop and not text[start:stop].isspace():
            add("#text", start, start, stop, text[start:stop], [], up)

    while m := _TAG.search(text, at):
        up = opened[-1] if opened else None
        plain(at, m.start(), up)
        at = m.end()
        if m[1]:
            end = _COMMENT.match(text, at)
            at = end.end() if end else len(text)
            continue
        if m[3] is None:
            at = text.find(">", at) + 1 or len(text)
            continue
        rest = attributes_of(text, at)
        if rest is None:
            return found
        tag, (attrs, at) = m[3].lower(), rest
        if m[2]:
            while open_tags[tag]:
                last = opened.pop()
                open_tags[last["tag"]] -= 1
                if last["tag"] == tag:
                    last["stop"] = at
                    break
            continue
        e = add(tag, m.start(), at, at, None, attrs, up)
        if tag in RAW and not (nested and tag == "noscript"):
            end = _END[tag].search(text, at)
            inner, stop = at, end.start() if end else len(text)
            e["body"] = text[inner:stop]
            closed = attributes_of(text, end.end()) if end else None
            e["stop"] = at = closed[1] if closed else len(text)
            if tag == "noscript":
                inside = elements_of(e["body"], FALLBACKS, names, nested=True)
                e["body"] = spliced(e["body"], outermost([{"start": x["start"], "stop": x["stop"], "new": ""} for x in inside]))
                for x in inside:
                    moved = add(x["tag"], x["start"] + inner, x["inner"] + inner, x["stop"] + inner, x["body"], x["attrs"], e)
                    for a in moved["attrs"]:
                        a["start"], a["stop"] = a["start"] + inner, a["stop"] + inner
            elif tag == "title":
                plain(inner, stop, e)
        elif tag not in VOID:
            opened.append(e)
            open_tags[tag] += 1
    plain(at, len(text), opened[-1] if opened else None)
    return found


def with_elements(pages: DataFrame, tags: Collection[str] | None = None, names: Collection[str] | None = None, bare: bool = True) -> DataFrame:
    """`pages` (html, and any other columns but `elements`) with the array of elements; null html has none. With `tags` or `names` only those elements (texts are "#text") and attributes leave Python; without `bare` only elements with one of the attributes, and styles."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small.slices(b, "html"):
                found = [elements_of(text or "", tags, names, bare) for text in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, _ARROW)], names=[*part.schema.names, "elements"])

    small.small_batches(pages.sparkSession)
    return pages.mapInArrow(small.frugal(tokenize), StructType(pages.schema.fields + StructType.fromDDL(f"elements array<{ELEMENT}>").fields))


#: A page that a step failed on: the step, the kind of error, its message.
ERROR = "struct<step:string,kind:string,message:string>"
_ARROW_ERROR = pa.struct([("step", pa.string()), ("kind", pa.string()), ("message", pa.string())])


def with_elements_or_error(pages: DataFrame, tags: Collection[str] | None = None, names: Collection[str] | None = None, longest: int = 1 << 26) -> DataFrame:
    """with_elements(), and a column `error` (ERROR, null where all is well): a page that can't be read, or has more than `longest` characters, has no elements and an error instead of ending the task; the other pages aren't touched."""

    def read(text: str) -> tuple[list[dict], dict | None]:
        try:
            if len(text) > longest:
                raise OverflowError(f"more than {longest} characters")
            return elements_of(text, tags, names), None
        except Exception as x:  # noqa: BLE001 - whatever a page does is that page's row
            return [], {"step": "markup", "kind": type(x).__name__, "message": str(x)[:200]}

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small.slices(b, "html"):
                found = [read(text or "") for text in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], _ARROW), pa.array([e for _, e in found], _ARROW_ERROR)], names=[*part.schema.names, "elements", "error"])

    small.small_batches(pages.sparkSession)
    return pages.mapInArrow(small.frugal(tokenize), StructType(pages.schema.fields + StructType.fromDDL(f"elements array<{ELEMENT}>, error {ERROR}").fields))


def elements(pages: DataFrame, tags: Collection[str] | None = None, names: Collection[str] | None = None, bare: bool = True) -> DataFrame:
    """page_id and the fields of ELEMENT for every element and text of `pages` (page_id, html), or those asked for."""
    return with_elements(pages.select("page_id", "html"), tags, names, bare).select("page_id", F.inline("elements"))


def value_of(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, null without one."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(1))["value"]


def attribute(name: str) -> Column:
    return value_of(F.col("attrs"), name)


# ----------------------------------------------------------------------- edits


def outermost(edits: list[dict]) -> list[dict]:
    """Of edits (start, stop, and others) those that lie in no earlier one: by start, insertions first, then the longest, then in their order."""
    kept, reach = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], e["stop"] != e["start"], -e["stop"])):
        if e["start"] >= reach:
            kept.append(e)
            reach = max(reach, e["stop"])
    return kept


def spliced(text: str, edits: list[dict]) -> str:
    """The text with outermost edits (start, stop, new) applied: the pieces between them and the new texts, put together once."""
    pieces, at = [], 0
    for e in edits:
        pieces += [text[at : e["start"]], e["new"] or ""]
        at = e["stop"]
    return "".join([*pieces, text[at:]])


def with_outermost(rows: DataFrame, html: str | None = "html") -> DataFrame:
    """`rows` with the outermost ones of their `edits` (array of structs with start, stop and new, offsets in characters of the column `html`), applied to that column; with None as its name they are only chosen. Null text and null edits stay null."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in small.slices(b, html or "html"):
                at = part.schema.get_field_index("edits")
                kept = [e if e is None else outermost(e) for e in part.column(at).to_pylist()]
                columns = [*part.columns]
                columns[at] = pa.array(kept, part.schema.field(at).type)
                if html is not None:
                    where = part.schema.get_field_index(html)
                    texts = part.column(where).to_pylist()
                    columns[where] = pa.array([t if t is None or not e else spliced(t, e) for t, e in zip(texts, kept)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    small.small_batches(rows.sparkSession)
    return rows.mapInArrow(small.frugal(apply), StructType([StructField(f.name, f.dataType) for f in rows.schema]))
