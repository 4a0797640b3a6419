"""The pipeline's stages on planted cases, and the catalog."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from pagemill.llm import catalog, common, mixing

NUMBERS = set(range(1, 14))


def test_a_query_for_each_operator():
    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == NUMBERS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in ("ara", "ote", "uni") for c in ("s", "nd", "k", "rt")]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(120)]
        if i % 6 == 0:
            text[rng.randrange(120)] = "horrid-scumbags"
        rows.append([i, " ".join(text), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(i % 6 == 0)))
    rows[11][1] = rows[10][1].replace(" ", "\n ")  # a copy
    rows[14][1] = rows[13][1] + " more"  # a near copy
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, corpus):
    docs = common.table(spark, corpus, "documents")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        if name == "mixing sources to target weights":
            due = sorted((t, r.doc_id) for r in mixing.mix(docs).collect() for t in r.positions)
        docs = common.saved(stage(spark, docs, corpus), "stage")
        left.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [r.doc_id for r in docs.orderBy("part", "row").collect()] == [i for _, i in due]
    clean, copies, near, mixed, encoded = left
    assert set(clean) == {i for i in range(300) if i % 6}
    assert set(clean) - set(copies) == {11} and set(copies) - set(near) == {14}
    assert set(mixed) <= set(near) and max(mixed.values()) == 2 and encoded == mixed
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, corpus).select("doc_id").collect()) == encoded


def test_encoding_reads_the_order_beside_own_columns(spark):
    rows = spark.createDataFrame([(i, f"word{i}", "own") for i in range(5)], "doc_id long, text string, _metadata string")
    done = corpus_pipeline.encode(spark, common.saved(rows.coalesce(1), "own"), "")
    assert sorted((r.part, r.row, r.doc_id) for r in done.collect()) == [(0, i, i) for i in range(5)]
