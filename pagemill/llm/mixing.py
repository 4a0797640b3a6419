"""Operator 5: mixing sources to target weights along a curriculum that varies over training time."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Weight schedules of the sources in the same order, repeating: (training time, relative weight) at the ends of linear pieces.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)))


def n_words(text: Column) -> Column:
    """Words of a text; null has none. Counts the starts of words, as many as there are."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, place, source_size, weight, target for each row of `sizes` (source, source_size).

    The sources share `share` times all words by weight. A target stops at `most` times its source's size, and the excess
    goes to the others by weight until none is above: in the order of most * size / weight the first sources are at
    their limits, and the rest share what those leave.
    """
    everyone = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("limit", most * F.col("source_size").cast("double"))
    order = everyone.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = limited.select(
        "*",
        (share * F.sum("source_size").over(everyone).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("sharing"),
    )
    level = F.max(F.when(F.col("limit") / F.col("weight") >= F.col("left") / F.col("sharing"), F.col("left") / F.col("sharing"))).over(everyone)
    shared = filled.withColumn("level", level)
    return shared.select("source", "place", "source_size", "weight", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))).alias("target"))


def schedule_pieces(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """Linear pieces (t0, t1, w0, w1, demand before t0) of a schedule, its integral over all time made 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    found, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        found.append((t0, t1, w0 / area, w1 / area, done))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return found


def when_due(share: Column, place: Column, schedules: tuple) -> Column:
    """Training time at which a source (by its place) has asked for `share` of its target: its cumulative demand, inverted piece by piece."""

    def inverse(pieces: list) -> Column:
        out = F.lit(float(pieces[-1][1]))
        for t0, t1, w0, w1, done in reversed(pieces):
            slope = (w1 - w0) / (t1 - t0)
            over = F.greatest(share - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * over, F.lit(0.0)))
            t = t0 + F.coalesce(F.try_divide(2.0 * over, w0 + root), F.lit(0.0))
            end = done + (t1 - t0) * (w0 + w1) / 2
            out = F.when(share < end, F.least(t, F.lit(float(t1)))).otherwise(out)
        return out

    kinds = [inverse(schedule_pieces(s)) for s in schedules]
    out = kinds[-1]
    for i, k in enumerate(kinds[:-1]):
        out = F.when(place % len(schedules) == i, k).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, share: float = 1.5, most: float = 2.0, cells: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions per row of `docs` (doc_id, text, source).

    A source's documents stand in a fixed random order (by the MD5 of the doc_id, then doc_id and size); the mix goes through them, again
    from the start where the target is above the source's size, until it has taken the target's words. `taken` counts
    them, the last document's part included. `positions` has the training times (0 to 1) at which the document is due, one
    for each time it is taken: the source's weight schedule, integrated and inverted at the words that come before.
    Running sums come from the sums of `cells` equal ranges of the MD5, so that no source meets in one task: a range for about
    100,000 documents, 256 to 65,536 of them, where it isn't given; results don't depend on it. A null doc_id
    counts as an empty string in the order; rows that repeat one doc_id are mixed one by one; null sources are one source.
    """
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ring"))
    slim = common.saved(slim, "sizes")
    cells = cells or 1 << min(16, max(8, (slim.count() // 100_000).bit_length()))
    slim = slim.withColumn("cell", (F.conv(F.substring("ring", 1, 4), 16, 10).cast("int") * cells / 65_536).cast("int"))
    parts = slim.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    by_cell = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("words").over(by_cell), F.lit(0)))
    goals = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    cells_of = before.withColumn("s", source).drop("source").join(goals.withColumn("s", source).drop("source"), "s")
    rows = slim.withColumn("s", source).join(cells_of.drop("words").hint("merge"), ["s", "cell"])
    inside = Window.partitionBy("s", "cell").orderBy("ring", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    size, n = F.col("size"), F.col("source_size")
    rounds = [F.least(F.greatest(whole - F.col("start") - k * n, F.lit(0)), size) for k in range(int(-(-most // 1)))]
    taken = sum(rounds[1:], rounds[0])
    dues = [F.when(r > 0, when_due((F.col("start") + k * n) / F.greatest(whole, F.lit(1)), F.col("place"), schedules)) for k, r in enumerate(rounds)]
    placed = rows.withColumn("start", start)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.filter(F.array(*dues), lambda t: t.isNotNull()).alias("positions"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """`docs`, each document as often as the mix takes it, range-sorted by training position; equal positions go by doc_id, then by a hash of all columns that can be hashed, so only rows alike in them are interchangeable.

    The document at which a source's target ends is there whole; rows that share a doc_id are taken alike, null ids too. Columns may
    have any names. The order of all rows is the same in every run; where Spark cuts it into partitions isn't.
    """
    tag = uuid.uuid4().hex
    doc_id, positions, position = (f"_{name}_{tag}" for name in ("doc_id", "positions", "position"))
    due = mix(docs, **how).where("taken > 0").groupBy(F.col("doc_id").alias(doc_id)).agg(F.min("positions").alias(positions))
    copies = docs.join(due, docs["doc_id"].eqNullSafe(F.col(doc_id))).withColumn(position, F.explode(positions))
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    plain = [quoted(f.name) for f in docs.schema.fields if not re.search(r"map<|variant", f.dataType.simpleString())]
    return copies.orderBy(position, "doc_id", F.xxhash64(*plain)).select(*map(quoted, docs.columns))


def _due_sql(share: str, place: str) -> str:
    number = lambda x: f"{float(x)!r}e0"  # noqa: E731  a double
    kinds = []
    for i, schedule in enumerate(SCHEDULES):
        pieces = schedule_pieces(schedule)
        cases = ""
        for t0, t1, w0, w1, done in pieces:
            over = f"greatest({share} - {number(done)}, 0e0)"
            root = f"sqrt(greatest({number(w0 * w0)} + {number(2.0 * ((w1 - w0) / (t1 - t0)))} * {over}, 0e0))"
            cases += f" WHEN {share} < {number(done + (t1 - t0) * (w0 + w1) / 2)} THEN least({number(t0)} + 2e0 * {over} / ({number(w0)} + {root}), {number(t1)})"
        kinds.append(f"WHEN {place} % {len(SCHEDULES)} = {i} THEN CASE {cases} ELSE {number(pieces[-1][1])} END")
    return f"CASE {' '.join(kinds)} END"


QUERIES = {"op5_mix": op5_mix}
ORACLE_SQL = {
    "op5_mix": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ring FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
        w AS (SELECT *, 2e0 * source_size AS lim, CAST(CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS DOUBLE) AS weight FROM s),
        f AS (SELECT *, 1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS rest,
            sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w),
        t AS (SELECT *, least(lim, weight * max(CASE WHEN lim / weight >= rest / sharing THEN rest / sharing END) OVER ()) AS target FROM f),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.place, t.target, CAST(floor(t.target + 0.5e0) AS BIGINT) AS goal,
            CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ring, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        p AS (SELECT *, least(greatest(goal - start, 0), size) AS first_round, least(greatest(goal - start - source_size, 0), size) AS second_round FROM r)
        SELECT doc_id, size, source_size, target, CAST(first_round + second_round AS BIGINT) AS taken,
            CASE WHEN first_round > 0 THEN {_due_sql("(CAST(start AS DOUBLE) / greatest(goal, 1))", "place")}
            WHEN second_round > 0 THEN {_due_sql("(CAST(start + source_size AS DOUBLE) / greatest(goal, 1))", "place")} END AS position FROM p"""
}
