"""Operator 2: quality rules with n-gram perplexity.

The language model is over the characters of words, each between a start and an end mark, up to ORDER characters: modified
Kneser-Ney with interpolation, one model a language, counted and smoothed by Spark. Its entries go to the tasks as arrays
sorted by a 64-bit hash of language and n-gram. A document's perplexity is over all its words; each language has a lower and
an upper limit, from the median and the spread of the log perplexities of all its documents. As the log perplexity is a mean
over words, the limits are wider for short documents, by the root of the number of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common

ORDER = 5
START, STOP = "\x02", "\x03"
#: Most entries (probabilities and back-off weights) of a model that is broadcast; a larger one of the same order is joined instead.
MAX_ENTRIES = 12_000_000
#: Robust standard deviations from a language's median that documents may have, below and above.
LOWER, UPPER = 3.5, 3.5
#: Log perplexities, and their deviations times the root of the number of words, count in bins of these widths for the limits.
BIN, DEVIATION_BIN = 0.001, 0.01
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


# ----------------------------------------------------------------- the counts


def word_counts(docs: DataFrame) -> DataFrame:
    """lang (null: empty), word, n over all texts; each task sums up its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w.decode(), n) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(text.encode().split())
            if sum(map(len, seen.values())) > 800_000:
                yield out()
        yield out()

    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams_of(word: str, order: int) -> Column:
    """For each character of a word and its end, the n-gram that ends there: of `order` characters, or from the start mark on."""
    w = F.concat(F.lit(START), word, F.lit(STOP))
    return F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.substring(w, F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))))


def gram_counts(words: DataFrame, order: int) -> list[DataFrame]:
    """For n from 1 to `order`: lang, gram (n characters), c. The highest order counts occurrences; a lower one how many characters stand before the n-gram, or occurrences where only the start can."""
    whole = common.saved(words.select("lang", "n", F.explode(grams_of("word", order)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c")), "grams")
    found = [whole.where(F.length("gram") == order)]
    for n in range(order - 1, 0, -1):
        before = found[0].groupBy("lang", F.expr(f"substring(gram, 2, {n})").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        found.insert(0, common.saved(before.unionByName(whole.where(F.length("gram") == n)), "grams"))
    return found


def discounts(counts: DataFrame) -> DataFrame:
    """lang, rows (its n-grams), d1, d2, d3 of one order, by Chen and Goodman's formulas; where a count of counts is missing, 0.5, 1 and 1.5."""
    n = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.5 * i).alias(f"d{i}") for i in (1, 2, 3)]
    return n.select("lang", "rows", *d)


def smoothed(counts: list[DataFrame]) -> list[DataFrame]:
    """For each order: lang, gram, p (interpolated probability of the last character after the others), context, gamma (the context's weight of the lower order)."""
    found: list[DataFrame] = []
    for n, rows in enumerate(counts, 1):
        rows = common.join_facts(rows, common.saved(discounts(rows), "discounts"), "lang", "rows")
        c = F.col("c")
        discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", "gram", c.cast("double").alias("c"), discount.alias("d"), F.expr(f"substring(gram, 1, {n - 1})").alias("context"), c.alias("n"))
        near = Window.partitionBy("lang", "context")
        total = F.sum("c").over(near)
        rows = rows.select("lang", "gram", "context", "n", ((F.col("c") - F.col("d")) / total).alias("own"), (F.sum("d").over(near) / total).alias("gamma"), F.count(F.lit(1)).over(near).alias("kinds"))
        if n == 1:
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") / (F.col("kinds") + 1))
        else:
            lower = found[-1].select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
            rows = rows.withColumn("shorter", F.expr(f"substring(gram, 2, {n - 1})")).join(lower, ["lang", "shorter"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
        found.append(common.saved(rows.select("lang", "gram", "p", "context", "gamma", "kinds", F.col("n").alias("c")), "smoothed"))
    return found


# ------------------------------------------------------------ the hash arrays

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _next(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * _MIX
    return h ^ (h >> np.uint64(29))


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Model:
    """Log probabilities and log back-off weights in arrays sorted by hash, an array for each order."""

    def __init__(self, order: int, langs: list[str]):
        self.order = order
        self.seeds = {lang: _next(np.array([i + 1], np.uint64), np.array([7], np.uint64))[0] for i, lang in enumerate(langs)}
        self.unknown: dict[str, float] = {}
        self.p: list[tuple[np.ndarray, np.ndarray]] = []
        self.gamma: list[tuple[np.ndarray, np.ndarray]] = []

    def hashes(self, langs: list[str], grams: list[str], n: int) -> np.ndarray:
        h = np.array([self.seeds[x] for x in langs], np.uint64)
        codes = _code_points(grams).reshape(len(grams), n)
        for i in range(n):
            h = _next(h, codes[:, i])
        return h

    def table(self, langs: list[str], grams: list[str], n: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.hashes(langs, grams, n)
        by = np.argsort(keys)
        return keys[by], np.log(values[by]).astype(np.float32)

    def score(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word and its end."""
        marked = [f"{START}{w}{STOP}" for w in words]
        codes = _code_points(marked)
        lens = np.array([len(w) for w in marked])
        first = np.repeat(np.cumsum(lens) - lens, lens)
        at = np.arange(len(codes))
        place = at - first  # 0: the start mark
        by_len = [np.full(len(codes), self.seeds[lang], np.uint64)]  # hashes of the n characters from each place on
        for n in range(1, self.order + 1):
            h = by_len[-1].copy()
            k = max(0, len(codes) - n + 1)
            h[:k] = _next(by_len[-1][:k], codes[n - 1 :])
            by_len.append(h)
        out = np.zeros(len(codes))
        left = at[place > 0]
        for n in range(self.order, 0, -1):
            able = place[left] >= n - 1
            now, later = left[able], left[~able]
            start = now - n + 1
            found, value = _look(self.p[n - 1], by_len[n][start])
            out[now[found]] += value[found]
            now, start = now[~found], start[~found]
            if n > 1:
                known, weight = _look(self.gamma[n - 1], by_len[n - 1][start])
                out[now[known]] += weight[known]
            else:
                out[now] += self.unknown[lang]
            left = np.concatenate((later, now))
        return np.add.reduceat(out, np.cumsum(lens) - lens) if len(words) else np.zeros(0)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    i = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][i] == keys, table[1][i]


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of `docs` (text, lang)."""
    return gathered(smoothed(gram_counts(common.saved(word_counts(docs), "words"), order)))


def gathered(tables: list[DataFrame]) -> Model:
    """The model of the smoothed `tables`, whose size the caller has checked."""
    order = len(tables)
    langs = sorted(r.lang for r in tables[0].select("lang").distinct().collect())
    model = Model(order, langs)
    for n, t in enumerate(tables, 1):
        rows = t.select("lang", "gram", "p").toArrow()
        model.p.append(model.table(rows.column("lang").to_pylist(), rows.column("gram").to_pylist(), n, rows.column("p").to_numpy()))
        rows = t.select("lang", "context", "gamma", "kinds").distinct().toArrow()
        own, weights = rows.column("lang").to_pylist(), rows.column("gamma").to_numpy()
        if n == 1:
            model.unknown = {x: float(np.log(g / (k + 1))) for x, g, k in zip(own, weights, rows.column("kinds").to_pylist())}
        model.gamma.append(model.table(own, rows.column("context").to_pylist(), n - 1, weights) if n > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
    return model


# ------------------------------------------------------------------ the rules


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def repeat_words(words: list[bytes]) -> int:
    """Words in five-word windows that are in the text twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    marks = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            marks[i : i + 5] = b"\1\1\1\1\1"
    return sum(marks)


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


def measured(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang and the columns of RULES for each row of `docs`; log_ppl is null without words or a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = model is not None
    known: dict[str, dict[bytes, float]] = {}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = text.encode().split()
                own = known.setdefault(lang, {})
                logs = list(map(own.get, words)) if scored else []
                if None in logs:
                    if sum(map(len, known.values())) > 600_000:
                        for x in known.values():
                            x.clear()
                    new = list(set(words).difference(own))
                    own.update(zip(new, shared.value.score(lang, [w.decode() for w in new]).tolist()))
                    logs = [own[w] for w in words]
                chars = len(text) - sum(map(text.count, SPACES))
                rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(words), -sum(logs) / (chars + len(words)) if words and scored else None))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 6, [pa.int64()] * 5 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], names=["doc_id", "lang", *(x.split()[0] for x in RULES.split(", "))])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(measure, f"doc_id long, lang string, {RULES}")


def measured_by_join(docs: DataFrame, words: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """As measured(), for the `docs` that the smoothed `tables` were counted from (`words`: their word_counts): nothing is gathered.

    Every n-gram of these words is in the model, so none needs a lower order: a word's score sums its n-grams' log
    probabilities, a document's its words'. Rows are numbered, as they may repeat.
    """
    order = len(tables)
    key = lambda *names: F.xxhash64(*names)
    used = [t.where(F.length("gram") == order) if n == order else t.where(F.col("gram").startswith(START)) for n, t in enumerate(tables, 1)]
    facts = used[0].select("lang", "gram", "p", "c")
    for t in used[1:]:
        facts = facts.unionByName(t.select("lang", "gram", "p", "c"))
    facts = facts.groupBy(key("lang", "gram").alias("key")).agg(F.max(F.log("p").cast("float")).cast("double").alias("log_p"), F.max("c").alias("c"))
    grams = words.select(key("lang", "word").alias("word_key"), F.col("lang"), F.explode(grams_of("word", order)).alias("gram"))
    by_gram = common.join_facts(grams.select("word_key", key("lang", "gram").alias("key")), common.saved(facts, "log-p"), "key", "c")
    docs_of = words.groupBy(key("lang", "word").alias("word_key")).agg(F.sum("n").alias("c"))
    scores = common.saved(by_gram.groupBy("word_key").agg(F.sum("log_p").alias("log_p")).join(docs_of, "word_key"), "word-scores")

    rows = common.saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    rules = measured(rows.select(F.col("row").alias("doc_id"), "lang", "text"), None).withColumnRenamed("doc_id", "row").drop("log_ppl")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, lang, text in zip(b.column("row").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen = Counter(text.encode().split())
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(seen)), pa.array([lang] * len(seen)), pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["row", "lang", "word", "n"])

    counted = rows.select("row", "lang", "text").mapInArrow(count, "row long, lang string, word string, n long")
    counted = common.saved(counted.select("row", "n", key("lang", "word").alias("word_key")), "row-words")
    logs = common.join_facts(counted, scores, "word_key", "c").groupBy("row").agg(F.sum(F.col("n") * F.col("log_p")).alias("log_p"))
    whole = rules.join(logs, "row", "left").join(rows.select("row", "doc_id"), "row")
    ratio = -F.col("log_p") / (F.col("word_chars") + F.col("n_words"))
    return whole.withColumn("log_ppl", F.when(F.col("n_words") > 0, ratio)).select("doc_id", "lang", *(x.split()[0] for x in RULES.split(", ")))


def quantiles(rows: DataFrame, value: Column, width: float, **levels: float) -> DataFrame:
    """lang, rows and a column for each of `levels`, from counts of bins: all rows count, and their order and partitions don't matter."""
    bins = rows.where("log_ppl IS NOT NULL").groupBy("lang", F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("lang")
    placed = bins.withColumns({"up_to": F.sum("n").over(every.orderBy("bin")), "all": F.sum("n").over(every)})
    return placed.groupBy("lang").agg(F.max("all").alias("rows"), *[(F.min(F.when(F.col("up_to") >= q * F.col("all"), F.col("bin"))) * width).alias(name) for name, q in levels.items()])


def bands(rows: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """lang, rows, middle, below, above: a document of n words may have a log_ppl from middle - below / sqrt(n) to middle + above / sqrt(n). The spread is the quartiles' distance over 0.6745, at least 0.1."""
    middle = common.saved(quantiles(rows, F.col("log_ppl"), BIN, middle=0.5), "middle")
    deviation = (F.col("log_ppl") - F.col("middle")) * F.sqrt("n_words")
    q = quantiles(common.join_facts(rows.where("log_ppl IS NOT NULL"), middle, "lang", "rows"), deviation, DEVIATION_BIN, q1=0.25, q3=0.75)
    spread = lambda x: F.greatest(x / 0.6745, F.lit(0.1))
    return middle.join(q.select("lang", (lower * spread(-F.col("q1"))).alias("below"), (upper * spread(F.col("q3"))).alias("above")), "lang")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """doc_id, the columns of RULES, base_failed, kept for each row of `docs` (doc_id, text, lang). Null texts have no words and fail the base rules; a null lang is a language of its own; repeated rows count each."""
    words = common.saved(word_counts(docs), "words")
    tables = smoothed(gram_counts(words, ORDER))
    small = sum(t.count() for t in tables) <= max_entries // 2
    rows = common.saved(measured(docs, gathered(tables)) if small else measured_by_join(docs, words, tables), "measured")
    unscored = [F.lit(None).cast("double").alias(c) for c in ("middle", "below", "above")]
    limited = common.join_facts(rows.where("log_ppl IS NOT NULL"), common.saved(bands(rows), "bands"), "lang", "rows").drop("rows").unionByName(rows.where("log_ppl IS NULL").select("*", *unscored))
    deviation = (F.col("log_ppl") - F.col("middle")) * F.sqrt("n_words")
    inside = F.coalesce(deviation.between(-F.col("below"), F.col("above")), F.lit(False))
    return limited.select("doc_id", *(x.split()[0] for x in RULES.split(", ")), base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_perplexity": op2_perplexity}
ORACLE_SQL: dict[str, str] = {}
