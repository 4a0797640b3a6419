"""Operator 7: toxicity by a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

A feature is a character n-gram of a word (lower case, points at its ends off, a space at either end), and counts once a
document. Spark counts in how many toxic and other documents each n-gram stands; the log-ratio of the two smoothed rates is
its scale. A logistic regression on the scaled features gives the weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common

ORDERS = (3, 4, 5)
THRESHOLD = 0.3
_ENDS = ".,;:!?()[]{}<>|&%$#*-_'\"“”«»„"


def grams(word: str) -> set[str]:
    w = f" {word.strip(_ENDS).lower()} "
    return {w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)}


@dataclass
class Model:
    """Log-odds of a document: bias plus the weights of its n-grams."""

    bias: float
    weights: dict[str, float]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, toxic of at most `max_rows` labelled rows that aren't held out: those with the least hashes. A doc_id with several labels is toxic if one says so."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one_each = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_docs: int = 3, least_z: float = 4.0, smoothing: float = 1.0) -> Model:
    """A model from the texts of a sample of at most `max_rows` labelled documents, which bounds what is broadcast and what the driver gets.

    n-grams in fewer than `min_docs` of them don't count, nor those whose log-count ratio is less than `least_z` times its
    standard error away from 0: these say nothing about the label. There is no cap on the others. Without labelled rows, or with one class only, the score is the smoothed share of toxic rows.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels, max_rows)), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = common.saved(rows, "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return Model(prior, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, Counter] = {0: Counter(), 1: Counter()}
        known: dict[str, set[str]] = {}

        def out() -> pa.RecordBatch:
            names = list({**of[0], **of[1]})
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([of[t][g] for g in names], pa.int64()) for t in (1, 0))], names=["gram", "pos", "neg"])

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = set(text.split())
                if len(known) > 8_000:  # a word's n-grams take some kilobytes
                    known.clear()
                for w in words.difference(known):
                    known[w] = grams(w)
                of[toxic].update(set().union(*(known[w] for w in words)))
            if len(of[0]) + len(of[1]) > 150_000:
                yield out()
                of = {0: Counter(), 1: Counter()}
        yield out()

    counted = rows.select("text", "toxic").mapInArrow(common.frugal(count), "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    a = smoothing
    ratio = F.log((F.col("p") + a) / (pos + 2 * a)) - F.log((F.col("n") + a) / (neg + 2 * a))
    scaled = counted.where(F.col("p") + F.col("n") >= min_docs).withColumn("ratio", ratio)
    sure = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("p") + a) + 1 / (F.col("n") + a))
    best = scaled.where(sure >= least_z).orderBy("gram").select("gram", "ratio").collect()
    index = {r.gram: i for i, r in enumerate(best)}
    ratios = np.array([r.ratio for r in best])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted({i for w in set(t.split()) for g in grams(w) if (i := index.get(g)) is not None}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])

    table = rows.mapInArrow(common.frugal(features), "doc_id long, toxic int, features array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = table.column("features").combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    weights, bias = fit(lists.flatten().to_numpy(), lens, table.column("toxic").to_numpy().astype(float), ratios, prior)
    return Model(bias, {g: float(weights[i]) for g, i in index.items() if weights[i]})


def fit(ids: np.ndarray, lens: np.ndarray, y: np.ndarray, scale: np.ndarray, bias: float, l2: float = 1e-4, rounds: int = 12, inner: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression with the feature values `scale`, by Newton's method with conjugate gradients: weights of the unscaled features, and the bias."""
    n, k = len(y), len(scale)
    row = np.repeat(np.arange(n), lens)
    values = scale[ids]

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, values * w[ids], n) + w[k]

    def back(e: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(ids, values * e[row], k), e.sum()) / n

    w = np.zeros(k + 1)
    w[k] = bias
    ridge = np.append(np.full(k, l2), 0.0)
    loss = lambda w, m: np.mean(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(ridge * w * w)
    m = margins(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        grad = back(p - y) + ridge * w
        curve = p * (1 - p)
        step, r = np.zeros(k + 1), -grad
        d, rr = r.copy(), r @ r
        for _ in range(inner):
            if rr < 1e-14:
                break
            h = back(curve * margins(d)) + (ridge + 1e-9) * d
            a = rr / (d @ h)
            step += a * d
            r -= a * h
            rr, old = r @ r, rr
            d = r + rr / old * d
        now, t = loss(w, m), 1.0
        moved = margins(step)
        while t > 1e-4 and loss(w + t * step, m + t * moved) > now:
            t /= 2
        w, m = w + t * step, m + t * moved
    return w[:k] * scale, float(w[k])


def scorer(spark: SparkSession, model: Model):
    """A column function: text to the probability that it is toxic; null counts as empty."""
    common.small_batches(spark)
    names = sorted(model.weights)
    shared = spark.sparkContext.broadcast((model.bias, {g: i for i, g in enumerate(names)}, [model.weights[g] for g in names]))
    known: dict[str, tuple[int, ...]] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        (bias, number, weights), out = shared.value, []
        for at in range(0, len(texts), 500):  # few texts at a time are Python objects
            for text in texts.slice(at, 500).to_pylist():
                words = set(text.split()) if text else set()
                if len(known) > 100_000:
                    known.clear()
                for w in words.difference(known):
                    known[w] = tuple({i for g in grams(w) if (i := number.get(g)) is not None})
                own = set().union(*filter(None, map(known.get, words)))
                for w in words:
                    if len(w) > 64:
                        del known[w]
                out.append(bias + sum(map(weights.__getitem__, sorted(own))))
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))), pa.float64())

    return score


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, common.table(spark, sf_dir, "labels")))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier doesn't call toxic, with all their columns. Each row is judged by its own text, repeated doc_ids and null ones too; an empty table stays empty."""
    return docs.where(scorer(docs.sparkSession, train(docs, labels))(docs["text"]) < THRESHOLD)


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
