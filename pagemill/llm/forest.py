"""Operator 12: approximate nearest neighbours by a forest of random-projection trees that share a priority queue, candidates ranked exactly."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common
from pagemill.llm.negatives import finite

#: The trees are fitted to at most so many rows and bytes of them, and end in leaves of about LEAF of these rows.
SAMPLE, SAMPLE_BYTES, LEAF, TREES = 16_384, 32 << 20, 32, 4
#: The search is calibrated on at most so many queries, to find this share of their neighbours.
TRIED, RECALL = 256, 0.96
#: Rows of a leaf that a task ranks at a time.
PART = 4_096


@dataclass
class Tree:
    """Inner nodes by number: a direction, a threshold and two children, of which negative ones are leaves: ~number."""

    directions: np.ndarray
    thresholds: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaves: int = 0

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)
        todo = [(0 if self.children else ~0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                right = vectors[rows] @ self.directions[node] > self.thresholds[node]
                todo += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return out


def grown(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over the sample: each node splits its rows at the median of their projections on the direction between two random ones. Rows that no direction tells apart stay one leaf."""
    directions: list[np.ndarray] = []
    tree = Tree(sample)

    def grow(rows: np.ndarray) -> int:
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            length = np.linalg.norm(a - b)
            if not length:
                continue
            projected = sample[rows] @ ((a - b) / length)
            middle = float(np.median(projected))
            right = projected > middle
            if right.any() and not right.all():
                node = len(tree.children)
                directions.append((a - b) / length)
                tree.thresholds.append(middle)
                tree.children.append((0, 0))
                tree.children[node] = (grow(rows[~right]), grow(rows[right]))
                return node
        tree.leaves += 1
        return ~(tree.leaves - 1)

    grow(np.arange(len(sample)))
    tree.directions = np.array(directions).reshape(len(directions), sample.shape[1])
    return tree


def visits(forest: list[Tree], sizes: list[list[int]], query: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order in which the queue that all trees share gives them out, until the leaves have `budget` rows: nearest first, by the sum of the squares of the distances to the splits that were crossed."""
    margins = [t.directions @ query - np.array(t.thresholds) if t.children else None for t in forest]
    queue = [(0.0, i, 0 if t.children else ~0) for i, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue and budget > 0:
        far, i, node = heapq.heappop(queue)
        while node >= 0:
            margin, (left, right) = float(margins[i][node]), forest[i].children[node]
            near, other = (right, left) if margin > 0 else (left, right)
            heapq.heappush(queue, (far + margin * margin, i, other))
            node = near
        budget -= sizes[i][~node]
        yield i, ~node


def dense(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of `width` doubles, missing ones 0."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows with a last component that makes all as long as the longest: then the largest inner product is the nearest point."""
    return np.hstack([vectors, np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))[:, None]])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The inner product of each row with its counterpart, added up from the first component to the last: the same whatever block it is in."""
    return np.cumsum(queries * vectors, axis=1)[:, -1]


def best_of(queries: np.ndarray, vectors: np.ndarray, firsts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the `most` best vectors of each query, scores exactly as products() has them, ties by `firsts`. The block's own matrix product only picks rows that may be among them."""
    rough = queries @ vectors.T
    near = np.linalg.norm(queries, axis=1, keepdims=True) * np.linalg.norm(vectors, axis=1).max(initial=0) * 1e-12
    if len(vectors) > most:
        keep = rough >= np.partition(rough, len(vectors) - most, axis=1)[:, [len(vectors) - most]] - near
    else:
        keep = np.ones_like(rough, bool)
    q, v = np.nonzero(keep)
    scores = products(queries[q], vectors[v])
    order = np.lexsort((firsts[v], -scores, q))
    q, v, scores = q[order], v[order], scores[order]
    starts = np.searchsorted(q, np.arange(len(queries)))
    kept = np.arange(len(q)) - starts[q] < most
    return q[kept], v[kept], scores[kept]


def floor(query: np.ndarray, sample: tuple[np.ndarray, np.ndarray], spots: list[tuple[int, int]], most: int) -> float:
    """The score that `most` rows of the sample in the leaves `spots` reach, less what sums of other orders may differ by; minus infinity if there are fewer."""
    vectors, leaves = sample
    there = np.zeros(len(vectors), bool)
    for t in range(len(leaves)):
        there |= np.isin(leaves[t], [leaf for tree, leaf in spots if tree == t])
    near = vectors[there]
    if len(near) < most:
        return -np.inf
    scores = near @ query
    return float(np.partition(scores, len(scores) - most)[len(scores) - most] - 1e-12 * np.linalg.norm(query) * np.linalg.norm(near, axis=1).max())


# ------------------------------------------------------------------------ rows


def key(vector: Column) -> Column:
    """Two hashes of 64 bits as one text."""
    return F.concat(F.lpad(F.hex(F.xxhash64(vector)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), vector)), 16, "0"))


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), key: the rows that take part, one for each vec_id: of several the one with the least vector. Rows without vec_id, and vectors that are null, zero or have a null or non-finite component, take no part."""
    whole = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    least = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return least.withColumn("key", key(F.col("vector")))


def alike(whole: DataFrame, most: int) -> DataFrame:
    """key, vector, ids (ascending) of each different vector of `whole`: its `most` smallest vec_ids, as no query's answer has more of one vector. Every task sends at most so many rows of a vector."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    first = whole.withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy("key").agg(F.min_by("vector", "vec_id").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


@dataclass
class Index:
    """A forest, the sample it was fitted to (vectors, and the leaf of each in each tree), and the rows in its leaves: `classes` (key, vector, ids), `leaves` (tree, leaf, key, vector, ids), how many each leaf has, the vectors' dimensions and greatest length."""

    forest: list[Tree]
    sample: tuple[np.ndarray, np.ndarray]
    classes: DataFrame
    leaves: DataFrame
    sizes: list[list[int]]
    width: int
    longest: float


def build(whole: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, seed: int = 12) -> Index:
    """An index of all rows of vectors(). The trees are fitted to the SAMPLE rows with the smallest hashes, fewer if they had over SAMPLE_BYTES; every row is in one leaf of each tree.

    A tree has at most 2 * SAMPLE / leaf leaves, so with more rows leaves grow; their rows are ranked in parts of about
    PART, which tasks share. Forest and sizes go to tasks as a broadcast: TREES * 2 * SAMPLE / LEAF directions.
    """
    spark = whole.sparkSession
    classes = common.saved(alike(whole, k + 1), "vectors")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, width, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.sqrt(F.max(length))).first()
    width, longest = width or 1, longest or 0.0
    taken = min(SAMPLE, max(2 * leaf, SAMPLE_BYTES // (8 * width)))
    sample = classes.select("vector", "key").orderBy("key").limit(taken).select("vector").toArrow()["vector"]
    sample = dense(sample, width)
    points = lifted(sample, longest)
    forest = [grown(points, leaf, np.random.default_rng([seed, t])) for t in range(trees)] if n else []
    shared = spark.sparkContext.broadcast((forest, width, longest))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, wide, most = shared.value
        for b in batches:
            at = lifted(dense(b.column("vector"), wide), most)
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(tree.leaf_of(at)), *b.columns], names=["tree", "leaf", *b.schema.names])

    placed = common.saved(classes.mapInArrow(place, "tree int, leaf int, key string, vector array<double>, ids array<long>"), "leaves")
    counts = {(r["tree"], r["leaf"]): r["count"] for r in placed.groupBy("tree", "leaf").count().collect()}
    sizes = [[counts.get((t, x), 0) for x in range(tree.leaves)] for t, tree in enumerate(forest)]
    return Index(forest, (sample, np.array([t.leaf_of(points) for t in forest])), classes, placed, sizes, width, longest)


def exact(classes: DataFrame, queries: list[np.ndarray], most: int) -> DataFrame:
    """query (place in `queries`, a bounded list), key, ids, score: the `most` best rows of `classes` for each, by brute force. Every task sends at most so many for each query and batch."""
    asked = np.array(queries)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v, score = best_of(asked, dense(b.column("vector"), asked.shape[1]), _firsts(b.column("ids")), most)
            at = pa.array(v)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column("key").take(at), b.column("ids").take(at), pa.array(score)], names=["query", "key", "ids", "score"])

    found = classes.mapInArrow(rank, "query int, key string, ids array<long>, score double")
    return _first_rows(found, ["query"], most)


def _firsts(ids: pa.Array) -> np.ndarray:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.flatten().to_numpy()[np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))[:-1]]).astype(np.int64)] if len(ids) else np.zeros(0, np.int64)


def _first_rows(found: DataFrame, by: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.element_at("ids", 1)))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """Rows that a search has to see: the least number of them with which TRIED of the queries (those with the smallest hashes) find the share `recall` of their k nearest, all rows searched by brute force."""
    asked = queries.select("key", "vector").dropDuplicates(["key"]).orderBy("key").limit(TRIED).select("vector").toArrow()["vector"]
    asked = dense(asked, index.width)
    if not len(asked) or not index.forest:
        return 0
    true = exact(index.classes, list(asked), k)
    places = index.leaves.select("key", "tree", "leaf").join(F.broadcast(true.select("query", "key")), "key").select("query", "key", "tree", "leaf").collect()
    where: dict[int, dict[str, set]] = defaultdict(lambda: defaultdict(set))
    for r in places:
        where[r["query"]][r["key"]].add((r["tree"], r["leaf"]))
    needed: list[int] = []
    total = sum(map(sum, index.sizes))
    for q, rows in where.items():
        seen, missing = 0, dict(rows)
        for spot in visits(index.forest, index.sizes, lifted(asked[[q]], index.longest)[0], total + 1):
            hit = [x for x, spots in missing.items() if spot in spots]
            needed += [seen + 1] * len(hit)
            missing = {x: s for x, s in missing.items() if x not in hit}
            seen += index.sizes[spot[0]][spot[1]]
            if not missing:
                break
    return sorted(needed)[max(0, -(-int(recall * 1000) * len(needed) // 1000) - 1)]


def search(index: Index, queries: DataFrame, k: int, budget: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of `queries` (vec_id, vector, key), own vec_id left out, ties by vec_id.

    Each different vector is searched for once: a task walks all trees by one queue until it has seen `budget` rows
    (calibrated() where none is given), then queries and rows meet by part of a leaf, and each part sends a query's best
    k + 1 classes at most, and of these none below the k + 1st best score of the sample's rows in the leaves that the query
    visits: as many others are better there. Shuffled are the rows once for each tree, and a query once for each group of leaves that it visits.
    """
    spark = queries.sparkSession
    if not index.forest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    budget = calibrated(index, queries, k) if budget is None else budget
    # leaves that stand beside each other make a group; the rows of a large leaf, in parts, a group each
    groups, parts, width = [], [], index.width
    for sizes in index.sizes:
        group, filled, of, cut = -1, PART, [], []
        for size in sizes:
            if filled + size > PART:
                group, filled = group + 1, 0
            filled += size
            of.append(group)
            cut.append(max(1, -(-size // PART)))
        groups.append(of)
        parts.append(cut)
    shared = spark.sparkContext.broadcast((index.forest, index.sizes, groups, parts, width, index.longest, index.sample))
    # counted from the distinct queries, for join_facts()
    asked = queries.groupBy("key").agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
    asked = common.saved(asked, "queries")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes, of, cut, wide, longest, sample = shared.value
        for b in batches:
            own, names = dense(b.column("vector"), wide), b.column("key")
            at = lifted(own, longest)
            for start in range(0, len(at), 256):
                rows: list[tuple] = []
                for x in range(start, min(start + 256, len(at))):
                    found: dict[tuple[int, int, int], list[int]] = defaultdict(list)
                    spots = list(visits(forest, sizes, at[x], budget))
                    least = floor(own[x], sample, spots, k + 1)
                    for t, leaf in spots:
                        for p in range(cut[t][leaf]):
                            found[t, of[t][leaf], p].append(leaf)
                    rows += [(*spot, x, least, sorted(leaves)) for spot, leaves in found.items()]
                cols = list(zip(*rows)) or [()] * 6
                take = pa.array(cols[3], pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), names.take(take), b.column("vector").take(take), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.list_(pa.int32()))], names=["tree", "group", "part", "key", "vector", "least", "leaves"])

    visited = asked.select("key", "vector").mapInArrow(walk, "tree int, group int, part int, key string, vector array<double>, least double, leaves array<int>")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, cut = shared.value[2:4]
        of, cut = [np.array(x, np.int32) for x in of], [np.array(x, np.int64) for x in cut]
        for b in batches:
            t, leaf = (b.column(c).to_numpy() for c in ("tree", "leaf"))
            group, n = np.zeros(len(t), np.int32), np.ones(len(t), np.int64)
            for x in np.unique(t):
                group[t == x], n[t == x] = of[x][leaf[t == x]], cut[x][leaf[t == x]]
            h = np.array([int(s[:8], 16) for s in b.column("key").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("tree"), pa.array(group), pa.array((h % n).astype(np.int32)), *b.columns[1:]], names=["tree", "group", "part", *b.schema.names[1:]])

    held = index.leaves.mapInArrow(grouped, "tree int, group int, part int, leaf int, key string, vector array<double>, ids array<long>")
    out = pa.schema([("query", pa.string()), ("key", pa.string()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        wants, rows, least = dense(left["vector"], width), dense(right["vector"], width), left["least"].to_numpy()
        leaf, firsts = right["leaf"].to_numpy(), _firsts(right["ids"])
        flat, sizes = left["leaves"].combine_chunks(), np.diff(left["leaves"].combine_chunks().offsets.to_numpy())
        who, which = np.repeat(np.arange(len(wants)), sizes), flat.flatten().to_numpy()
        found = []
        for x in np.unique(leaf):
            here, asks = np.flatnonzero(leaf == x), who[which == x]
            for start in range(0, len(asks), 1024):
                q, v, score = best_of(wants[asks[start : start + 1024]], rows[here], firsts[here], k + 1)
                found.append((asks[start : start + 1024][q], here[v], score))
        if not found:
            return out.empty_table()
        q, v, score = map(np.concatenate, zip(*found))
        order = np.lexsort((firsts[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        kept = (np.arange(len(q)) - np.searchsorted(q, np.arange(len(wants)))[q] <= k) & (score >= least[q])
        q, v = pa.array(q[kept]), pa.array(v[kept])
        return pa.table([left["key"].take(q), right["key"].take(v), right["ids"].take(v), pa.array(score[kept])], schema=out)

    spot = ["tree", "group", "part"]
    found = visited.groupBy(*spot).cogroup(held.groupBy(*spot)).applyInArrow(rank, "query string, key string, ids array<long>, score double")
    once = found.repartition("query").dropDuplicates(["query", "key"])
    answer = _first_rows(once, ["query"], k + 1).select("query", F.explode("ids").alias("vec_id"), "score")
    near = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "vec_id", "score")))
    facts = asked.select(F.col("key").alias("query"), "n").join(answer.groupBy("query").agg(F.slice(near, 1, k + 1).alias("near")), "query")
    rows = common.join_facts(queries.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")), common.saved(facts, "answers"), "query", "n")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def nearest(rows: DataFrame, query: Column, k: int = 20, budget: int | None = None) -> DataFrame:
    """The k nearest rows, by inner product, of the rows of `rows` (vec_id, embedding, and others) for which `query` (of vec_id) holds; see vectors(), build() and search(). An empty table has no answers; a query with fewer others has them all."""
    whole = common.saved(vectors(rows), "embeddings")
    return search(build(whole, k), whole.where(query), k, budget)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op12_nearest": op12_nearest}
ORACLE_SQL: dict[str, str] = {}
