"""Hard negatives and nearest neighbours against brute force, on rows with nulls, ties, repeats, clashing names and no rows at all."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import common, forest, negatives

NAN, INF = float("nan"), float("inf")
# with names that the operators use themselves
SCHEMA = "vec_id long, embedding array<float>, label int, vector string, key string, ids string, shard string, tree int, k int, x int, n int, query string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", "k", "i", "s", 1, 1, 1, 1, "q") for r in rows], SCHEMA).repartition(3)


def some(seed=0, n=260, d=40):
    rng = np.random.default_rng(seed)
    rows = [[i, rng.normal(0, 0.3, d).astype(np.float32).tolist(), int(rng.integers(0, 3))] for i in range(n)]
    for i in range(20, 60):
        rows[i][1] = rows[7][1]  # copies, so scores tie
    rows[3][1], rows[4][1], rows[5][1], rows[6][1], rows[8][2] = None, [0.1, None], [NAN, 1.0], [INF], None
    rows[9][1], rows[10][1], rows[11][1] = [], [0.0] * d, [0.5] * 3  # no, zero and few components
    return [tuple(r) for r in rows] + [(None, rows[1][1], 1), tuple(rows[12]), tuple(rows[12]), (13, [9.0], 0), (13, [-9.0], 2)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_negatives(rows, every=100):
    least = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        x = (label, [int(np.floor(256 * float(c))) for c in v])
        least[i] = min(least.get(i, x), x)
    out = []
    for a in (i for i in least if i % every == 0):
        score = {b: dot(least[a][1], least[b][1]) for b in least if b != a}
        first = sorted((-s, b) for b, s in score.items() if least[b][0] == least[a][0])[:5]
        for minus, p in first:
            window = sorted((-s, b) for b, s in score.items() if least[b][0] != least[a][0] and 80 * -minus <= 100 * s <= 100 * -minus)[:5]
            out += [(a, p, r, b, -minus, -s) for r, (s, b) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("every", [100, 10, 7])
def test_negatives_equal_brute_force_over_many_tiles(spark, monkeypatch, every):
    for name, value in (("ANCHORS", 8), ("ROWS", 32), ("DIMENSIONS", 16)):
        monkeypatch.setattr(negatives, name, value)
    rows = some()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % every == 0, label)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, every)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, [1.0], 0), (2, [1.0], 1)], [(100, [1.0], 0)]):
        assert negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_saved_files_grow_with_the_rows_not_with_the_scores(spark, monkeypatch, tmp_path):
    sizes = []
    for n in (400, 1600):
        monkeypatch.setattr(common, "shared_dir", lambda spark, n=n: f"file://{tmp_path}/{n}")
        rows = [r for r in some(1, n, 8) if r[0] is not None]
        assert negatives.mine(frame(spark, rows), F.col("vec_id") >= 0).count() > n
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(n)).rglob("*.parquet")))
    assert sizes[1] < 6 * sizes[0]  # four times the rows, all of them anchors: 16 times the scores


def test_large_scores_and_windows_stay_exact(spark):
    big = [2.0**15, -(2.0**15), 3.0, 2.0**15 - 1]
    rows = [(i, [big[i % 4], big[(i // 4) % 4], float(i)], i % 2) for i in range(64)]
    rows = [(i * 10, v, c) for i, v, c in rows]
    want = brute_negatives(rows, 20)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert want and max(abs(r[4]) for r in want) > 1 << 45 and sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, label).collect())) == want


def test_products_are_exact_or_an_error():
    a, b = np.array([[3, -(2**24) - 1]]), np.array([[5, 2**29 + 1], [2**29, 7]])
    assert negatives.product(a, b).tolist() == [[15 - (2**24 + 1) * (2**29 + 1), 3 * 2**29 - 7 * (2**24 + 1)]]
    with pytest.raises(OverflowError):
        negatives.product(np.array([[2**40]]), np.array([[2**40]]))


def brute_nearest(rows, every, k=20):
    least = {}
    for i, v, _ in rows:
        if None in (i, v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        least[i] = min(least.get(i, v), v)
    wide = max(map(len, least.values()))
    full = {i: np.array([*map(float, v), *[0.0] * (wide - len(v))]) for i, v in least.items()}
    out = {}
    for q in (i for i in full if i % every == 0):
        best = sorted((-float(np.cumsum(full[q] * full[i])[-1]), i) for i in full if i != q)[:k]
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("part", [4096, 16])
def test_nearest_with_the_whole_budget_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(forest, "PART", part)  # large leaves in parts, few leaves in a group
    monkeypatch.setattr(forest, "LEAF", 20)
    rows = some()
    got = answers(forest.nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, budget=10**9))
    want = brute_nearest(rows, 5)
    assert got == want and len(want) > 40


def test_nearest_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 16).tolist(), 0) for i in range(1500)]
    got, want = answers(forest.nearest(frame(spark, rows), F.col("vec_id") % 4 == 0)), brute_nearest([(i, np.float32(v).tolist(), x) for i, v, x in rows], 4)
    assert got.keys() == want.keys()
    hit = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.93


def test_nearest_few_equal_or_no_rows(spark):
    assert forest.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert forest.nearest(frame(spark, [(1, [1.0], 0)]), F.col("vec_id") % 20 == 0).count() == 0
    assert answers(forest.nearest(frame(spark, [(20, [1.0], 0), (1, [2.0], 0)]), F.col("vec_id") % 20 == 0)) == {20: [(1, 1, 2.0)]}
    same = [(i, [0.5, 0.5], 0) for i in range(90)]  # one vector: the smallest other ids
    assert answers(forest.nearest(frame(spark, same), F.col("vec_id") % 20 == 0)) == brute_nearest(same, 20)


def test_a_tree_puts_every_row_in_one_leaf_and_the_queue_gives_all_leaves():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 8))
    trees = [forest.grown(points, 16, np.random.default_rng(i)) for i in range(3)]
    leaves = [t.leaf_of(points) for t in trees]
    sizes = [np.bincount(x, minlength=t.leaves).tolist() for x, t in zip(leaves, trees)]
    assert all(sum(s) == 400 and max(s) <= 16 for s in sizes)
    order = list(forest.visits(trees, sizes, points[5], 10**9))
    assert Counter(order) == Counter((t, x) for t, tree in enumerate(trees) for x in range(tree.leaves))
    assert {(t, leaves[t][5]) for t in range(3)} == set(order[:3])
    assert len(list(forest.visits(trees, sizes, points[5], 1))) == 1
