"""Operator 9: SimHash near-duplicates, found in sharded BK-trees.

Fingerprints are 64 bits wide. Two that differ in at most `radius` bits agree on at least one of radius + 1 pieces of the
64 bits, and in the rest again on one of radius + 1 pieces, so every linked pair meets in one of (radius + 1)^2 kinds of
shard. A shard's distinct fingerprints form a BK-tree: a node's children are keyed by their Hamming distance to it, and a
search follows only edges within the radius of its own distance. The trees reach their shards by the shuffle that groups
them: no size bound on a broadcast of them would hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common


def fingerprint(text: str | None, width: int) -> int:
    """SimHash (signed 64-bit) of the text's word shingles, A-Z in lower case; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (long) per row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.frugal(add), "doc_id long, fp long")


class BkTree:
    """Integers by Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            d = (node ^ x).bit_count()
            if d <= radius:
                found.append(node)
            own = self.children[node]
            todo += [own[k] for k in range(d - radius, d + radius + 1) if k in own]
        return found

    def add(self, x: int) -> None:
        self.children.setdefault(x, {})
        if self.root is None:
            self.root = x
            return
        node = self.root
        while d := (node ^ x).bit_count():
            nxt = self.children[node].get(d)
            if nxt is None:
                self.children[node][d] = x
                return
            node = nxt


def shard_links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what lies within the radius in one shard: from each fingerprint to the first of its class, so never all pairs."""
    tree, parent = BkTree(), {x: x for x in fps}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in fps:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(x)
    return [(top(x), x) for x in fps if top(x) != x]


def pieces(bits: list[int], n: int) -> list[list[int]]:
    """n runs of nearly equal length."""
    return [list(x) for x in np.array_split(np.array(bits), n)]


def mask(bits: list[int]) -> int:
    m = sum(1 << int(b) for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def shard_masks(radius: int) -> list[int]:
    """For each kind of shard, the bits (as a signed long) that its fingerprints share."""
    found = []
    for first in pieces(list(range(64)), radius + 1):
        rest = [b for b in range(64) if b not in first]
        found += [mask(first + second) for second in pieces(rest, radius + 1)]
    return found


def links(fps: DataFrame, radius: int) -> DataFrame:
    """a, b: links among the distinct fingerprints `fps` (fp) that make the same classes as all pairs within the radius."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(shard_masks(radius))])
    rows = fps.select("fp", F.explode(kinds).alias("s")).select("s.kind", "s.bits", "fp")
    sorted_rows = rows.repartition("kind", "bits").sortWithinPartitions("kind", "bits", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        ended = False
        batches = iter(batches)
        while not ended:
            b = next(batches, None)
            ended = b is None
            if b is not None:
                kept = [np.concatenate((k, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64))) for i, k in enumerate(kept)]
            kind, bits, fp = kept
            if not len(fp):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (bits[1:] != bits[:-1]))))
            ends = np.append(starts[1:], len(fp))
            if not ended:  # the last shard may go on
                kept = [k[starts[-1] :] for k in kept]
                starts, ends = starts[:-1], ends[:-1]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                out += shard_links([x & 0xFFFFFFFFFFFFFFFF for x in fp[s:e].tolist()], radius)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return sorted_rows.mapInArrow(common.frugal(search), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has a link: root is the least node reachable. Large-star and small-star steps in turn, each pass a table in the shared folder."""
    spark = edges.sparkSession
    now = common.saved(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "links")
    state = None
    while True:
        # large star: neighbours above a node go to the least of its neighbours and itself
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = common.join_facts(both.where("v > u"), common.saved(least, "least"), "u", "n").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        large = common.saved(large, "links")
        low = common.saved(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = common.join_facts(large, low, "hi", "n").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct()
        nxt = common.saved(small, "links")
        new_state = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        now = nxt
        if new_state == state or new_state[0] == 0:
            break
        state = new_state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()) if state else spark.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over fingerprints within the radius) for every row of `docs` (doc_id, text).

    Texts without words, null ones too, have fingerprint 0. Equal fingerprints count once in the search. Rows with a null
    doc_id are searched like any other but never name a component that has another row.
    """
    rows = common.saved(with_fingerprints(docs, width), "fingerprints")
    return named(rows, components(links(rows.select("fp").distinct(), radius))).select("doc_id", "fp", "component_id")


def named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` (doc_id, fp, and others) with component_id, from the links' `roots` (node, root) among the fps."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = common.saved(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "classes")
    ids = common.saved(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "roots")
    ids = common.join_facts(classes, ids, "root", "members").select("fp", "n", "component_id")
    return common.join_facts(rows, common.saved(ids, "classes"), "fp", "n").drop("n")


# ------------------------------------------------- wide fingerprints, by similarity

#: A text is in BANDS shards, each named by ROWS minima: a pair of Jaccard similarity s meets with 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8.
BANDS, ROWS = 16, 5
#: Rows and shingles of a shard's block, which is one tree. A shard of several blocks is never in one task.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
#: Rows that search a tree at once.
SEEKERS = 500
_STEPS = np.random.default_rng(9).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.random.default_rng(10).integers(1 << 62, (1 << 63) - 1, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Bits are bytes of 64-bit lanes, summed 255 rows at a time, which no byte overflows."""
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, so that a task holds few texts as Python objects."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


class WordHashes(dict):
    """XXH64 of words, some 100,000 kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_word_hashes = WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of the text's distinct word shingles (A-Z in lower case), ascending; fewer words than `width` are one shingle; empty without words."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if not words or n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)][: len(words)], np.uint64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    found = hashes[:n].copy()
    for i in range(1, width):
        found = (found ^ (found >> np.uint64(29))) * _STEPS[0] + hashes[i : n + i]
    return np.unique((found ^ (found >> np.uint64(31))) * _STEPS[1])


def wide_fingerprint(hashes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of 64 * n bits, as n longs: each hash is mixed n times. Without hashes, zeros."""
    ones = np.zeros((n, 64), np.int64)
    for i in range(0, len(hashes), 16_384):
        part = hashes[i : i + 16_384]
        for j in range(n):
            mixed = (part ^ (part >> np.uint64(31))) * _STEPS[j]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEPS[63 - j]
            ones[j] += bit_counts(mixed)
    return np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").view("<i8")


def shards_of(hashes: np.ndarray) -> list[int]:
    """The BANDS shards of a set of hashes: ROWS least hashes each, in orders of their own. None for an empty set."""
    if not len(hashes):
        return []
    least = np.array([(hashes * a).min() for a in _ORDERS]).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)], np.uint64).view(np.int64).tolist()


def radius_of(similarity: float, bits: int) -> int:
    """A Hamming distance that sets with that Jaccard similarity stay within: the mean (their angle's share of pi; a quarter more, which sets of few shingles reach by ties) and four standard deviations."""
    share = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return round(bits * share + 4 * np.sqrt(bits * share * (1 - share)))


class Block:
    """A shard's tree and what is known of its rows' classes. Links are checked by the sets of shingles, once for a class where that is enough."""

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.ids, self.sets = np.zeros(0, np.int64), []
        self.fps = np.zeros((0, 0), np.uint64)
        self.label = np.zeros(0, np.int64)

    def similar_to(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the rows `others` have the Jaccard similarity to the row `one`."""
        own = self.sets[one]
        sizes = np.array([len(self.sets[i]) for i in others])
        out = np.minimum(sizes, len(own)) >= self.similarity * np.maximum(sizes, len(own))
        if out.any():
            sizes = sizes[out]
            flat = np.concatenate([self.sets[i] for i in others[out]])
            shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)
            out[out] = shared >= self.similarity * (sizes + len(own) - shared)
        return out

    def search(self, ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], among: bool) -> list[tuple[int, int]]:
        """Links of the given rows. With `among` they become the tree, which all of them search; else they search the tree.

        A node is the first row of its subtree; the others go to its children by their distance to it. Searches go down
        together: at a node each row that still searches meets it, and goes on to the children within the radius of its
        distance. Rows that are already in the node's class aren't compared; so links are never all pairs, yet make the
        same classes.
        """
        n = len(self.ids)
        if not among and not n:  # a tree without rows
            return []
        tree = np.arange(n if not among else len(ids))
        if not among:
            kept = self.ids, self.fps, self.sets
            ids, fps, sets = np.concatenate((self.ids, ids)), np.concatenate((self.fps, fps)), self.sets + sets
        self.ids, self.fps, self.sets = ids, fps, sets
        self.label = np.concatenate((self.label[:n], np.arange(n, len(ids))))
        found, todo = [], [(tree, np.arange(n, len(ids)))]
        while todo:
            own, seekers = todo.pop()
            node = own[0]
            far = np.bitwise_count(fps[seekers] ^ fps[node]).sum(axis=1, dtype=np.int64)
            near = seekers[(far <= self.radius) & (self.label[seekers] != self.label[node])]
            if len(near):
                near = near[self.similar_to(node, near)]
                found += [(int(ids[node]), int(ids[i])) for i in near]
                joined = np.unique(np.append(self.label[near], self.label[node]))
                if len(joined) > 1:
                    self.label[np.isin(self.label, joined)] = joined[0]
            rest = own[1:]
            if len(rest):
                edge = np.bitwise_count(fps[rest] ^ fps[node]).sum(axis=1, dtype=np.int64)
                for k in np.unique(edge):
                    on = seekers[np.abs(far - k) <= self.radius]
                    if len(on):
                        todo.append((rest[edge == k], on))
        if not among:
            self.ids, self.fps, self.sets = kept
            self.label = self.label[:n]
        return found


def searched(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """a, b: links of `rows` (shard, block, seeks, fp, wide, shingles): in each block the rows that don't seek are the tree, the others search it."""
    dealt = rows.select("shard", "block", "seeks", "fp", "wide", "shingles").repartition("shard", "block").sortWithinPartitions("shard", "block", "seeks", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block(radius, similarity)
        waiting: list[tuple] = []
        seeks = False
        found: list[tuple[int, int]] = []

        def done() -> None:
            if waiting:
                ids = np.array([w[0] for w in waiting], np.int64)
                fps = np.frombuffer(b"".join(w[1] for w in waiting), "<u8").reshape(len(waiting), -1)
                found.extend(block.search(ids, fps, [np.frombuffer(w[2], "<u8") for w in waiting], among=not seeks))
                waiting.clear()

        for batch in batches:
            for shard, number, role, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, number) != at or role != seeks or seeks and len(waiting) == SEEKERS:
                    done()
                    if (shard, number) != at:
                        at, block = (shard, number), Block(radius, similarity)
                    seeks = role
                waiting.append(row)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
                found.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return common.saved(dealt.mapInArrow(common.frugal(search), "a long, b long").distinct(), "links")


def with_sets(docs: DataFrame, needed: DataFrame, width: int, n: int) -> DataFrame:
    """fp, wide (SimHash of 64 * n bits), shingles for the texts of `docs` whose text_hash is in `needed` (fp, text_hash)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            wide = [wide_fingerprint(x, n).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), pa.array(wide, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["text_hash", "wide", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = common.in_keys(texts, needed.select("text_hash"), ["text_hash"]).groupBy("text_hash").agg(F.first("text").alias("text"))
    return common.saved(texts.mapInArrow(common.frugal(add), "text_hash long, wide binary, shingles binary").join(needed.hint("merge"), "text_hash").select("fp", "wide", "shingles"), "sets")


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, n: int = 8, block_rows: int = BLOCK) -> DataFrame:
    """doc_id, fp, text_hash and component_id for every row of `docs` (doc_id, text): components of texts whose sets of word shingles have that Jaccard similarity or more.

    Texts meet in the shards of shards_of(); shards with the same texts are searched once. A shard's SimHashes of 64 * n
    bits form BK-trees, searched within radius_of(); every link is checked by the sets of shingles in the same task. A
    shard of several blocks has its first block's tree searched by all its rows, and then the other trees by the rows
    outside the shard's largest component. Nulls, empty texts and ties are as in near_duplicates(); fp is the XXH64 of
    the set of shingles.
    """
    radius = radius_of(similarity, 64 * n)
    common.small_batches(docs.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([shards_of(x) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "n", "shards"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = common.saved(texts.mapInArrow(common.frugal(add), "doc_id long, text_hash long, fp long, n long, shards array<long>"), "fingerprints")
    distinct = rows.where("n > 0").groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("shards").alias("shards"))
    distinct = common.saved(distinct, "distinct")

    members = distinct.select("fp", "n", F.explode("shards").alias("shard"))
    sums = members.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.bit_xor("fp").alias("x"), F.bit_xor(F.xxhash64("fp")).alias("y")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / block_rows, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    groups = common.saved(sums.groupBy("size", "x", "y").agg(F.min("shard").alias("shard"), F.first("shingles").alias("shingles")).select("shard", "size", blocks.alias("blocks")), "shards")
    placed = common.saved(common.join_facts(members.select("shard", "fp"), groups, "shard", "size").select("shard", "fp", "size", "blocks"), "members")

    needed = common.saved(placed.select("fp").distinct().join(distinct.select("fp", "text_hash"), "fp"), "needed")
    sets = with_sets(docs, needed, width, n)
    own = placed.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    first = own.select("shard", "fp", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block"), F.lit(False).alias("seeks"))
    others = own.where("block > 0").select("shard", "fp", "block", F.lit(True).alias("seeks"))
    links = searched(first.unionByName(others).join(sets.hint("merge"), "fp"), radius, similarity)

    if groups.where("blocks > 1").limit(1).count():
        roots = common.saved(components(links), "roots")
        rooted = common.saved(own.where("blocks > 1").join(roots, F.col("fp") == F.col("node"), "left").select("shard", "fp", "size", "blocks", "block", F.coalesce("root", "fp").alias("root")), "rooted")
        heads = rooted.groupBy("shard", "size", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("shard", "size").agg(F.max_by("root", F.struct("c", "root")).alias("head"))
        apart = common.join_facts(rooted.drop("size"), heads, "shard", "size").where("root <> head").select("shard", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("seeks"))
        trees = rooted.select("shard", "fp", "block", F.lit(False).alias("seeks"))
        links = links.unionByName(searched(trees.unionByName(apart).join(sets.hint("merge"), "fp"), radius, similarity))
    return named(rows.select("doc_id", "text_hash", "fp"), components(links))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of their component, with all their columns. Components without any doc_id stay whole; an empty table stays empty."""
    dropped = similar(docs, width, similarity).where("NOT doc_id <=> component_id").select("doc_id", "text_hash").distinct()
    return common.without_keys(docs, common.saved(dropped, "dropped"), [F.col("doc_id").cast("long"), F.xxhash64("text")])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
