"""Operator 13: fill-in-the-middle transformation, cutting texts at boundaries between their units."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagemill.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
#: How much text is held at a time, in characters.
HELD = 4 << 20
CUT = "n long, form string, prefix_chars long, middle_chars long, output string"
_SPACES = np.array([*range(0x09, 0x0E), 0x20], np.uint32)


def points(text: str) -> np.ndarray:
    """The code points of a text (lone surrogates included)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A number for each code point; a unit ends where the next one has another. A word takes the white space behind it along, a line its line feed; white space at the start is a word of its own."""
    if unit == "char":
        return np.arange(len(codes))
    if unit == "line":
        ends = codes == 0x0A
    else:
        space = np.isin(codes, _SPACES)
        ends = space & ~np.append(space[1:], False)
    return np.concatenate([[0], np.cumsum(ends[:-1])]) if len(codes) else np.arange(0)


def cuts(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units start and end: 0, the boundaries, the length. There are as many units as numbers, less one."""
    of = classes(codes, unit)
    inner = np.flatnonzero(of[1:] != of[:-1]) + 1
    return np.concatenate([[0], inner, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def draws(doc_id: int | None, epoch: int) -> list[int]:
    """Four numbers below 2^32 for a document, the same in every run; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(text: str, doc_id: int | None, unit: str = "char", rate: int = 90, spm: int = 20, epoch: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), characters of prefix and middle, and the output of one document."""
    codes = points(text)
    at = cuts(codes, unit)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(doc_id, epoch)
    if not n or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = piece(codes[:first]), piece(codes[first:last]), piece(codes[last:])
    if h4 % 100 < spm:
        return n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made from. Markers can't lie across pieces, and pieces have none, so the first of each is the own one."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, middle = output.removeprefix(one).partition(MIDDLE)
    left, _, right = head.partition(two)
    prefix, suffix = (right, left) if form == "spm" else (left, right)
    return prefix + middle + suffix


def transform(docs: DataFrame, unit: str = "char", rate: int = 90, spm: int = 20, epoch: int = 1) -> DataFrame:
    """`docs` (doc_id, text, and others) with n (units of the text), form, prefix_chars, middle_chars and output.

    `unit` is char (code points), word or line; of 100 documents `rate` are cut, of those `spm` have the suffix first.
    Nothing is shuffled, and a text is only in the memory of its own task, about HELD characters of texts at a time. A
    null text counts as empty, an empty one stays plain, as does one that holds a marker. A null doc_id draws as one
    without digits; rows that share doc_id and text come out alike. Columns of `docs` with the new names give way; an
    empty table stays empty.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is none of {UNITS}")
    new = StructType.fromDDL(CUT)
    rows = docs.drop(*new.names).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    arrow = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, texts, ids = 0, b.column("text"), b.column("doc_id")
            while start < b.num_rows:
                out, held, stop = [], 0, start
                while stop < b.num_rows and (held < HELD or stop == start):
                    text = texts[stop].as_py()
                    out.append(transformed(text, ids[stop].as_py(), unit, rate, spm, epoch))
                    held += len(text)
                    stop += 1
                yield pa.RecordBatch.from_arrays([*b.slice(start, stop - start).columns, *(pa.array(c, t) for c, t in zip(zip(*out), arrow.types))], names=[*b.schema.names, *arrow.names])
                start = stop

    return rows.mapInArrow(cut, StructType([StructField(f.name, f.dataType) for f in rows.schema] + new.fields))


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: of rows of transform() the digests of the output and of the text that is rebuilt from output and form alone."""
    slim = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            outputs, forms = b.column("output"), b.column("form")
            sums = [(sha(o), sha(restored(o, f))) for o, f in ((outputs[i].as_py(), forms[i].as_py()) for i in range(b.num_rows))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([s[0] for s in sums], pa.string()), pa.array([s[1] for s in sums], pa.string())], names=[*b.schema.names[:5], "output_sha256", "restored_sha256"])

    schema = StructType([*slim.schema.fields[:5], *StructType.fromDDL("output_sha256 string, restored_sha256 string").fields])
    return slim.mapInArrow(rebuild, schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into code points; see transform() and digests()."""
    return digests(transform(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


_h = [f"CAST('0x' || substr(d, {i}, 8) AS BIGINT)" for i in (1, 9, 17, 25)]
ORACLE = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
b AS (SELECT *, CAST(length(t) AS BIGINT) AS n, {', '.join(f'{e} AS h{i}' for i, e in enumerate(_h, 1))} FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, substring(t, 1, p) AS a1, substring(t, p + 1, q - p) AS a2, substring(t, q + 1) AS a3 FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a1 || '{SUFFIX}' || a3 || '{MIDDLE}' || a2 ELSE '{SUFFIX}' || a3 || '{PREFIX}' || a1 || '{MIDDLE}' || a2 END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM e
"""
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE_SQL = {"op13_fill_in_middle": ORACLE}
