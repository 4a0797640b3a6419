"""Fill-in-the-middle against a plain rebuilding of the rules, for all units."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import middle

SCHEMA = "doc_id long, text string, n string, form int, output string, prefix_chars string, lang string"
TEXTS = [None, "", " ", "a", "two words", "a<P>b", "x <S> y", "<M>", "日本語 😀 é", "line\nline\n\nend", "word " * 20000, "<", "<P", "ends <S", "İx\tß"]


def units(text, unit):
    pattern = {"char": r"(?s).", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    return re.findall(pattern, text)


def plain(doc_id, text, unit="char"):
    text = text or ""
    u = units(text, unit)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", middle.UNITS)
def test_equals_the_plain_rules(spark, unit):
    rows = [(i if i % 5 else None, TEXTS[i % len(TEXTS)]) for i in range(90)]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame([(*r, "n", 1, "o", "p", "en") for r in rows], SCHEMA).repartition(3)
    out = middle.transform(df, unit)
    assert out.columns == ["doc_id", "text", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=key) == sorted(((i, *plain(i, t, unit)) for i, t in rows), key=key)
    assert {f for _, f, *_ in (plain(i, t) for i, t in rows)} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in middle.digests(out).collect()), key=key)
    assert got == sorted(((i, sha(plain(i, t, unit)[4]), sha(t or "")) for i, t in rows), key=key)


def test_no_rows_and_no_such_unit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert middle.digests(middle.transform(empty)).count() == 0
    with pytest.raises(ValueError):
        middle.transform(empty, "syllable")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM a\n😀é", max_size=40), st.integers(0, 10**6), st.sampled_from(middle.UNITS))
def test_every_output_gives_its_text_back(text, doc_id, unit):
    n, form, p, m, output = middle.transformed(text, doc_id, unit)
    assert n == len(units(text, unit)) and middle.restored(output, form) == text
    if form != "plain":
        assert p + m <= len(text) and output.count("<P>") == output.count("<S>") == output.count("<M>") == 1
