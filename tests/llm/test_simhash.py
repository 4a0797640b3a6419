import random

import numpy as np
import xxhash

from pagemill.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string, node string"  # with names that clash with the operator's own


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, radius):
    parent = {x: x for x in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in parent:
        for y in parent:
            if (x ^ y).bit_count() <= radius:
                parent[top(x)] = top(y)
    return {x: top(x) for x in parent}


def test_fingerprint_is_the_plain_simhash():
    for text in (None, "", " \t\n", "One", "one two", "A b C d e f", "ÀÉ x y z " * 50, "a\x0bb\x0cc \xa0d"):
        assert simhash.fingerprint(text, 3) & 0xFFFFFFFFFFFFFFFF == plain(text)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    xs = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(10)})
    tree = simhash.BkTree()
    for x in xs:
        tree.add(x)
    for x in xs[:80]:
        assert sorted(tree.within(x, 2)) == sorted(y for y in xs if (x ^ y).bit_count() <= 2)


def test_every_close_pair_shares_a_shard():
    masks = [m & 0xFFFFFFFFFFFFFFFF for m in simhash.shard_masks(2)]
    rng = random.Random(1)
    for _ in range(3000):
        x = (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        assert any(not x & m for m in masks)


def test_components_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60, 120]))]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(text)
            if copy and rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy) or rng.choice(["", None]))
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(docs)] + [(None, docs[5], "x", "y", "z"), (3, docs[3], "x", "y", "z")]
    got = {(r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [plain(t) for _, t, *_ in rows]
    root = classes(fps, 2)
    least = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == {(r[0], f, least.get(root[f])) for r, f in zip(rows, fps)}
    assert len(set(least.values())) < len(set(fps))


def test_long_chain_and_empty_table(spark):
    fps = [(1 << i) - 1 for i in range(0, 60, 2)]
    edges = spark.createDataFrame([(a, b) for a, b in zip(fps, fps[1:])], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similar_texts_meet(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(3):
            text = list(base)
            for _ in range(c):  # a changed word leaves 290 of 302 five-word shingles
                text[rng.randrange(300)] = "other"
            rows.append((3 * g + c, " ".join(text)))
            want[3 * g + c] = 3 * g
    rows += [(500, None), (501, ""), (None, "w1"), (502, "w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    assert sum(got[i] == c for i, c in want.items()) >= 0.98 * len(want)
    assert all(got[i] // 3 == i // 3 for i in want)
    assert got[501] == 500 and got[502] == 502 and got[None] == 502
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_block_links_make_the_classes_of_all_pairs():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range(8):
            x = base.copy()
            x[: rng.integers(0, 14)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
            sets.append(np.unique(x))
    fps = np.array([simhash.wide_fingerprint(x, 8).view(np.uint64) for x in sets])
    ids = np.arange(len(sets))
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8

    def tops(links):
        parent = {i: i for i in ids.tolist()}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(top(a), top(b))] = min(top(a), top(b))
        return [top(i) for i in parent]

    want = tops([(i, j) for i in ids.tolist() for j in range(i) if like(sets[i], sets[j])])
    whole = simhash.Block(simhash.radius_of(0.8, 512), 0.8).search(ids, fps, sets, True)
    assert tops(whole) == want and len(whole) < len(ids) and all(like(sets[a], sets[b]) for a, b in whole)
    block = simhash.Block(simhash.radius_of(0.8, 512), 0.8)  # half are the tree, the others search it in two parts
    found = block.search(ids[:48], fps[:48], sets[:48], True)
    for k in (48, 72):
        found += block.search(ids[k : k + 24], fps[k : k + 24], sets[k : k + 24], False)
    across = [(i, j) for i in range(96) for j in range(min(i, 48)) if like(sets[i], sets[j])]
    assert tops(found) == tops(across)


def test_similarity_is_the_exact_jaccard_of_planted_pairs(spark):
    rng = random.Random(11)
    rows, near, far = [], [], []
    for size, limit in ((20, 0.8), (200, 0.8), (200, 0.85), (200, 0.75)):
        for _ in range(150):
            g = len(rows)
            n_shared = -(-round(1000 * limit) * size // 1000)  # one text has the other's first shingles and no others
            words = [f"w{rng.getrandbits(48)}" for _ in range(size + 4)]
            rows += [(g, " ".join(words)), (g + 1, " ".join(words[: n_shared + 4]))]
            (near if limit >= 0.8 else far).append(g)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[g + 1] == g for g in near) >= 0.99 * len(near)
    assert all(got[g + 1] == g + 1 for g in far)


def test_chains_around_a_shards_pivot(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 204])) for i in range(9)]  # neighbours have 180 of 220 shingles
    for block_rows in (1000, 2):  # and in shards of several blocks
        got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows).collect()
        assert {r.component_id for r in got} == {0}


def test_split_shards_give_the_same_components(spark):
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(15):
            text = list(base)
            for _ in range(rng.randrange(8)):
                text[rng.randrange(150)] = f"n{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.component_id) for r in simhash.similar(df).collect()}
    assert whole == {(r.doc_id, r.component_id) for r in simhash.similar(df, block_rows=4).collect()}
    assert 6 < len({c for _, c in whole}) < len(rows)
