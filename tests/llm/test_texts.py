"""Edge cases of the operators on texts: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names."""

import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import balance, bpe, common, exactdedup, licenses, mixing, perplexity, tokenfiles, toxicity, warc, wordcache

# with names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, text_sha256 string, keep_id string, shard string, size string, _arc int, k int, h int, codes int, norm string, position int, arc int"
TEXTS = [None, "", " ", "a", "Hello  world\n x", "Hello world x", "hello \x1c world  x", "İstanbul J̌ STRASSE ß", "a<|endoftext|> b <|startoftext|>c <|ENDOFTEXT|>", "日本語 テスト 12345 !!", "word " * 3000, "x" * 5000, "tab\tand\r\nlines \n  spaces   end ", "it's they'll 'x' 3.14 @user_name #tag"]


def docs(spark, texts=None):
    texts = TEXTS if texts is None else texts
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None][i % 3], 0, "d", "t", "k", "s", "z", 1, 1, 1, 1, "n", 1, 1) for i, t in enumerate(texts)]
    if texts:
        rows += [(None, "null id", None, None, None, *[None] * 12), rows[5], (3, *rows[4][1:])]  # a null id, a repeated row, an id with another text
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def some(spark):
    return docs(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    return docs(spark, [])


def listed(spark, folder):
    return [r.asDict() for r in common.manifest(spark, folder).orderBy("shard", "seq").collect()]


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_word_table_equals_the_library(spark, some, none):
    tok = wordcache.load(bpe.TOKENIZER)

    def want(text):
        ids = tok.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(some).collect())
    assert got == Counter((i, *want(t)) for i, t in pairs(some))
    assert bpe.digests(none).count() == 0
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(some)).collect()}
    assert back == {(i, tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in pairs(some)}


def test_word_table_with_a_tiny_head(spark, some):
    small = Counter(map(tuple, bpe.digests(some, head_words=3).collect()))
    assert small == Counter(map(tuple, bpe.digests(some).collect()))


def test_word_table_with_repeated_rows_and_a_long_common_word(spark):
    long, text = "x" * 3000, "zyzzyva qwrtpl " * 3
    rows = [(1, text)] * 400 + [(i, f"{long} a{i}") for i in range(2, 60)] + [(None, text)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tok = wordcache.load(bpe.TOKENIZER)
    want = lambda t: hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
    got = Counter((r.doc_id, r.ids_sha256) for r in bpe.digests(df, head_words=2).collect())
    assert got == Counter((i, want(t)) for i, t in rows)


@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=300))
def test_varints(codes):
    data, lens = bpe.varints(np.array(codes, np.int64))
    assert len(data) == lens.sum()
    assert bpe.from_varints(data)[0].tolist() == codes


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=500))
def test_simple8b_round_trip(ids):
    words, escaped = tokenfiles.pack(np.array(ids, np.uint64))
    assert tokenfiles.unpack(words, escaped, len(ids)).tolist() == ids
    assert len(escaped) == sum(i >= 1 << 60 for i in ids)


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=" \n\t ab'sé.,!1<|>　", max_size=40))
def test_cached_ids_equal_the_library(text):
    bpe_ = wordcache.byte_bpe("byte_bpe_50k.json")
    assert np.frombuffer(bpe_.ids(text), np.uint32).tolist() == bpe_.tok.encode(text, add_special_tokens=False).ids


def test_cached_parts_are_bounded():
    """Many different words leave a worker's cache small, and evicted ones get the same ids again."""
    own = wordcache.ByteBpe("byte_bpe_50k.json")
    texts = [" ".join(f"{i:x}z.{'é' * (i % 3)}" for i in range(at, at + 20_000)) + "\nx y|\n" for at in range(0, 560_000, 20_000)]
    for text in texts:
        own.ids(text)
    kept = [d for d in vars(own).values() if isinstance(d, dict)]
    assert max(map(len, kept)) <= 500_000
    assert np.frombuffer(own.ids(texts[0]), np.uint32).tolist() == own.tok.encode(texts[0], add_special_tokens=False).ids


def test_token_files(spark, some, none, tmp_path):
    tok = wordcache.load("byte_bpe_50k.json")
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    for f in folders:
        tokenfiles.write(some, f, shard_bytes=4000)
    assert [(r["name"], r["size"]) for r in listed(spark, folders[0])] == [(r["name"], r["size"]) for r in listed(spark, folders[1])]
    assert len(listed(spark, folders[0])) > 3
    assert all((tmp_path / "a" / r["name"]).read_bytes() == (tmp_path / "b" / r["name"]).read_bytes() for r in listed(spark, folders[0]))
    assert not (tmp_path / "a" / "_temp").exists()
    rows = sorted(tokenfiles.read(spark, folders[0]).collect(), key=lambda r: r.start)
    ids = {t: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for _, t in pairs(some)}
    order = sorted(pairs(some), key=lambda p: (p[0] is None, p[0] or 0, p[1].encode()))
    start = 0
    assert len(rows) == len(order)
    for r, (i, t) in zip(rows, order):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids[t]), zlib.crc32(ids[t].tobytes()))
        start += len(ids[t])
    tokenfiles.write(none, f"file://{tmp_path}/none")
    assert tokenfiles.read(spark, f"file://{tmp_path}/none").count() == 0


def test_exact_dedup(spark, some, none, tmp_path):
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest()
    index = exactdedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    got = Counter(map(tuple, exactdedup.dedup(some, index).collect()))
    groups = {}
    for i, t in pairs(some):
        groups.setdefault(norm(t), []).append(i)
    keep = {d: min((i for i in g if i is not None), default=None) for d, g in groups.items()}
    assert got == Counter((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], norm(t)) for i, t in pairs(some))
    # the index persists: another batch meets it
    later = exactdedup.dedup(spark.createDataFrame([(100, "Hello world x"), (101, "new")], "doc_id long, text string"), exactdedup.DigestIndex(spark, f"file://{tmp_path}/index", 4))
    assert {(r.doc_id, r.kept) for r in later.collect()} == {(100, False), (101, True)}
    kept = exactdedup.keep_first(some)
    assert kept.columns == some.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(r.doc_id, r.text) for r in some.collect() if r.doc_id == keep[norm(r.text or "")]}
    assert exactdedup.keep_first(none).count() == 0


def test_hot_keys_meet_their_facts(spark):
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) AS key")
    facts = rows.groupBy("key").count()
    assert common.join_facts(rows, facts, "key", "count").where("key = 'hot' AND count = 10000").count() == 10_000
    assert common.join_facts(rows, facts, "key", "count").count() == 30_000


def test_range_bounds_divide_far_apart_keys(spark):
    keys = [*range(1000), 1 << 62, -(1 << 62)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    bounds = common.range_bounds(df, "k", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1), 100)
    per = Counter(np.searchsorted(bounds, keys, side="right").tolist())
    assert max(per.values()) <= 200 and len(bounds) >= 8


def test_mix(spark, some, none):
    rows = mixing.mix(some, cells=4).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sorted(r.size for r in rows) == sorted(size(t) for _, t in pairs(some))
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in g) for s, g in by.items()}
    left, goal, open_ = 1.5 * sum(sizes.values()), {}, {s: w for s, w in zip(["a", "b", None], (3, 1, 2))}
    while open_:  # stop at the limit, share the excess again
        level = left / sum(open_.values())
        over = {s for s, w in open_.items() if w * level > 2 * sizes[s]}
        goal |= {s: 2.0 * sizes[s] if s in over else w * level for s, w in open_.items() if s in over or not over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s in over or over} if over else {}
        open_ = {s: w for s, w in open_.items() if s not in over}
    for s, g in by.items():
        assert all(r.target == pytest.approx(goal[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in g)
        assert abs(sum(r.taken for r in g) - goal[s]) <= 0.5
        assert all(len(r.positions) == -(-r.taken // r.size) if r.size else r.positions == [] for r in g)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(some.repartition(5), cells=4).collect()), key=str)
    assert mixing.mix(none).count() == 0
    ordered = mixing.training_order(some)
    assert ordered.columns == some.columns and mixing.training_order(none).count() == 0


def test_mix_does_not_depend_on_cells(spark, some):
    assert Counter(map(str, mixing.mix(some, cells=4).collect())) == Counter(map(str, mixing.mix(some).collect()))


def test_training_order_with_any_names_and_equal_positions(spark):
    names = ["doc_id", "text", "source", "_id", "_positions", "_position", "_metadata", "positions", "taken", "cell", "a.b", "m"]
    rows = [(i % 7, f"a b c {i % 7}", "s", f"id{i}", i, "own", {"k": i}, i, i, i, i, i) for i in range(60)]
    kinds = ["long", "string", "string", "string", "int", "string", "map<string,int>", *["int"] * 5]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    once = mixing.training_order(df)
    assert once.columns == names
    first = once.collect()
    assert [r["_id"] for r in first] == [r["_id"] for r in mixing.training_order(df.repartition(7)).collect()]
    assert {r["_id"]: r["_position"] for r in first} == {f"id{i}": "own" for i in range(60)}


def test_schedules_are_inverted(spark):
    from pyspark.sql import functions as F

    shares = spark.range(101).select((F.col("id") / 101).alias("share"))
    for place, schedule in enumerate(mixing.SCHEDULES):
        t = [r.t for r in shares.select(mixing.when_due(F.col("share"), F.lit(place), mixing.SCHEDULES).alias("t")).collect()]
        assert t == sorted(t) and t[0] == 0 and t[-1] <= 1
        for share, x in zip((i / 101 for i in range(101)), t):
            grid = np.linspace(0, x, 2001)
            weight = np.interp(grid, *zip(*schedule))
            assert np.trapezoid(weight, grid) / np.trapezoid(np.interp(g := np.linspace(0, 1, 2001), *zip(*schedule)), g) == pytest.approx(share, abs=1e-3)


@pytest.mark.parametrize("n,shards", [(0, 4), (3, 4), (500, 16)])
def test_ring_equals_brute_force(spark, n, shards):
    rows = spark.createDataFrame([(i if i % 50 else None, i % 7) for i in range(n)], "doc_id long, tag int")
    got = balance.shard(rows, shards, nodes=8).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and (not n or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    # one key after the other: own arcs first, then on clockwise
    nodes = balance.ring(shards, 8)
    limits = balance.capacities(n, shards, 0.0)
    per_arc = {a: c for a, c in Counter(np.random.default_rng(n).integers(0, len(nodes), n).tolist()).items()}
    room, over, want = list(limits), [], Counter()
    for a in sorted(per_arc):
        for _ in range(per_arc[a]):
            s = nodes[a][1]
            if room[s]:
                room[s] -= 1
                want[a, s] += 1
            else:
                over.append(a)
    for a in over:
        at = a
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        room[nodes[at % len(nodes)][1]] -= 1
        want[a, nodes[at % len(nodes)][1]] += 1
    found = Counter()
    for arc, first, last, s, _ in balance.assign(per_arc, nodes, limits):
        found[arc, s] += last - first + 1
    assert found == want


def test_ring_on_odd_rows(spark, some, none):
    rows = balance.shard(some, 4).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in some.collect())
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert balance.shard(none, 4).count() == 0


def test_ratios_equal_their_definition(spark):
    texts = ["the vile scum", "a vile day", "the good day", "good vile scum", "the end", "a good end"]
    toxic = [1, 1, 0, 1, 0, 0]
    df = spark.createDataFrame([(4 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(4 * i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    used = [i for i in range(6) if zlib.crc32(str(4 * i).encode()) % 4 != 2]
    model = toxicity.train(df, labels, min_docs=1, least_z=0.0)
    held = [set().union(*map(toxicity.grams, texts[i].split())) for i in used]
    y = np.array([toxic[i] for i in used], float)
    names = sorted(set().union(*held))
    pos, neg = int(y.sum()), int((1 - y).sum())
    ratio = np.array([np.log((sum(g in h and t for h, t in zip(held, y)) + 1) / (pos + 2)) - np.log((sum(g in h and not t for h, t in zip(held, y)) + 1) / (neg + 2)) for g in names])
    x = np.array([[g in h for g in names] for h in held]) * ratio
    ours = np.array([model.weights.get(g, 0.0) for g in names])
    w = np.divide(ours, ratio, out=np.zeros(len(names)), where=ratio != 0)
    e = 1 / (1 + np.exp(-(x @ w + model.bias))) - y  # the gradient of the loss is 0 there
    assert np.abs(x.T @ e / len(y) + 1e-4 * w).max() < 2e-4 and abs(e.mean()) < 2e-4
    assert np.abs(ours).max() > 0.1


def test_few_rows_move_with_slack(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r["shard"] for r in balance.shard(rows, 8, slack=0.25).collect()}
    b = {r.doc_id: r["shard"] for r in balance.shard(rows, 9, slack=0.25).collect()}
    assert max(Counter(a.values()).values()) <= 1.25 * 4000 / 8 + 1
    assert sum(a[i] != b[i] for i in a) < 4000 * 0.35


def test_licenses_equal_brute_force(spark, none):
    texts = [*TEXTS, "Licensed under CC BY-NC 4.0.", "cc by cc by, all rights reserved", "GNU General Public License, version 3", "under the Apache License, Version 2.0 or the MIT License", "ALL RIGHTS RESERVED " * 50, "Copyright (c) 2020 by x. SPDX-License-Identifier: MPL 2.0", "this is free and unencumbered software released into the public domain"]
    rules = licenses.rules()
    assert len(rules) > 300

    def want(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        norm = " " + "".join(w + " " for w in words)
        base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        found = []
        for i, r in enumerate(rules):  # neither gate nor keyword
            for m in re.finditer(r["re"], norm):
                first = norm[: m.start()].count(" ")
                found.append((first, first + m[1].count(" ") - 1, r["priority"], i, r["label"], r["conf"]))
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and (a[:2] != b[:2] or b[2:4] < a[2:4])
        stays = [a for a in found if not any(inside(a, b) for b in found)]
        doubt = np.prod([1 - a[5] for a in stays]) if stays else 1.0
        at = [i for i, _ in base]
        labels = {label for _, label in base}
        return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {a[4] for a in stays})), round(1 - doubt, 9)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == want(texts[r.doc_id])
    assert licenses.scan(none).count() == 0


def test_the_longest_version_of_a_license_counts(spark):
    texts = {
        "GNU LGPL 2.1 or later": "lgpl-2.1-or-later",
        "licensed under the LGPL v2": "lgpl-2.0",
        "GPL version 2.0 only": "gpl-2.0",
        "GNU General Public License, version 3, or (at your option) any later version": "gpl,gpl-3.0-or-later",
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
        "CC BY-NC-ND 3.0": "cc-by,cc-by-nc-nd-3.0",
        "Apache License 2.0; MPL 1.1": "apache-2.0,mpl-1.1",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == dict(enumerate(texts.values()))


def test_license_keywords_are_in_what_they_gate():
    for r in licenses.rules():
        assert r["kw"].strip() in r["re"]


def test_toxicity(spark, none):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi") for b in ("ra", "te", "nu") for c in ("s", "n", "ld")]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        toxic = int(i % 5 == 0)
        if toxic:
            text[int(rng.integers(30))] = str(rng.choice(["vilescum", "Vilescums,", "vilescummy"]))
        rows.append((i, " ".join(text), 9))
        labels.append((i, toxic, 1))
    rows += [(None, None, 1), (1000, "", 1), (1001, "vilescum " * 20_000, 1)]
    labels += [(None, 1, 1), (5, None, 1), (0, 1, 0)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    score = toxicity.scorer(spark, toxicity.train(df, marks))
    got = {r.doc_id: r.score for r in df.select("doc_id", score("text").alias("score")).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[1001] > 0.3 and 0 <= got[1000] == got[None] < 0.3
    held = {r.doc_id: r.h for r in df.select("doc_id", toxicity.held_out(df.doc_id).alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns and kept.count() == len(rows) - 121
    assert toxicity.keep_clean(none, marks).count() == 0
    assert toxicity.train(df, marks.limit(0)).weights == {}


def kneser_ney(counts, order):
    """Modified Kneser-Ney over marked words by its definition: counts {word: n} of one language."""
    c = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        s = perplexity.START + w + perplexity.STOP
        for i in range(1, len(s)):
            g = s[max(0, i - order + 1) : i + 1]
            c[len(g)][g] += n
    for k in range(order - 1, 0, -1):
        for g in [g for g in c[k + 1]]:
            c[k][g[1:]] += 1
    d = [None]
    for k in range(1, order + 1):
        n = [sum(v == i for v in c[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d.append([0.0] + [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[1] and n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)])
    kinds = len(c[1])

    def p(g):
        k = len(g)
        near = [v for x, v in c[k].items() if x[:-1] == g[:-1]]
        lower = 1 / (kinds + 1) if k == 1 else p(g[1:])
        if not near:
            return lower
        v = c[k].get(g, 0)
        gamma = sum(d[k][min(x, 3)] for x in near) / sum(near)
        return (v - d[k][min(v, 3)]) / sum(near) + gamma * lower if v else gamma * lower

    def word(w):
        s = perplexity.START + w + perplexity.STOP
        return sum(np.log(p(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s)))

    return word


def test_language_model_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcé"), int(rng.integers(1, 6)))) for _ in range(40)) for _ in range(8)]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for order in (2, 5):
        model = perplexity.train(df, order)
        for lang, own in (("en", texts[1::2]), ("", texts[::2])):
            word = kneser_ney(Counter(" ".join(own).split()), order)
            probe = ["a", "abc", "cc", "z", "éaz", "aaaaaaa"]
            assert model.score(lang, probe) == pytest.approx([word(w) for w in probe], abs=1e-4)


def test_quality_rules(spark, some, none):
    def want(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = Counter(windows)
        covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)

    texts = [*TEXTS, "a b c d e f a b c d e g h i j k l m n o p", "one\ntwo\none\n\n\none", " ".join(f"w{i}" for i in range(40)), "#$% | <x> " * 9]
    rows = perplexity.judged(docs(spark, texts)).collect()
    expect = Counter((i, *want(t)) for i, t in pairs(docs(spark, texts)))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == expect
    assert not any(r.kept and r.base_failed for r in rows)
    assert perplexity.judged(none).count() == 0


def test_bands_equal_their_definition(spark):
    rng = np.random.default_rng(6)
    rows = [(i, str(lang), int(n), float(v)) for i, (lang, n, v) in enumerate(zip(rng.choice(["en", "de", "x"], 300, p=[0.6, 0.395, 0.005]), rng.integers(10, 400, 300), rng.normal(2, 0.3, 300)))]
    rows += [(900, "one", 50, 2.5), (901, "tie", 20, 1.0), (902, "tie", 20, 1.0), (903, "none", 0, None)]  # one document; ties; nothing to measure
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, log_ppl double")
    got = {r.lang: r for r in perplexity.bands(df).collect()}
    assert set(got) == {r[1] for r in rows} - {"none"}

    def quantile(values, q, width):
        bins = sorted(int(np.floor(v / width)) for v in values)
        return bins[int(np.ceil(q * len(bins) - 1e-9)) - 1] * width

    for lang, r in got.items():
        own = [(n, v) for _, x, n, v in rows if x == lang]
        middle = quantile([v for _, v in own], 0.5, perplexity.BIN)
        deviations = [(v - middle) * np.sqrt(n) for n, v in own]
        q1, q3 = (quantile(deviations, q, perplexity.DEVIATION_BIN) for q in (0.25, 0.75))
        assert (r.middle, r.below, r.above) == pytest.approx((middle, 3.5 * max(-q1 / 0.6745, 0.1), 3.5 * max(q3 / 0.6745, 0.1)), abs=1e-6)


def test_a_large_model_keeps_its_order(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)))) for _ in range(30)) for _ in range(12)] + ["", None]
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, texts[4], "en")], "doc_id long, text string, lang string")
    order = lambda found: sorted(map(tuple, found.collect()), key=str)
    small, large = order(perplexity.judged(df)), order(perplexity.judged(df, max_entries=10))
    assert [r[:6] + r[7:] for r in small] == [r[:6] + r[7:] for r in large] and len(small) == 16
    assert [r[6] or 0 for r in large] == pytest.approx([r[6] or 0 for r in small], abs=1e-9)


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 50
    pages = [(1, "https://a.test/x y\r\nX: 1", big), (2, None, None), (3, "u", big), (4, "u", "short"), (5, "u", "short"), (None, "n", big), (6, "u", ""), (7, "u", "z" * 300_000), (3, "u", big), (1, "again", big)]
    df = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id long, url string, html string, digest string, refers_to string").repartition(4)
    folders = [f"file://{tmp_path}/{x}" for x in "ab"]
    for f in folders:
        warc.write(df, f, shard_bytes=2000, roll_bytes=500)
    names = [r["name"] for r in listed(spark, folders[0])]
    assert names == [r["name"] for r in listed(spark, folders[1])] and len(names) > 2
    assert all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folders[0]).collect())

    def want(page_id, html):
        data = (html or "").encode()
        revisit = html == big and page_id != 1
        return page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None

    assert got == Counter(want(p, h) for p, _, h in pages)
    full = {r.page_id: r.payload for r in warc.read(spark, folders[0], payload=True).collect() if r.record_type == "response"}
    assert bytes(full[7]) == b"z" * 300_000 and bytes(full[2]) == b""
    raw = b"".join(data for n in names for _, data in warc.members(f"{folders[0]}/{n}"))
    assert gzip.decompress((tmp_path / "a" / names[0]).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert b"\nX: 1" not in raw and raw.count(b"WARC/1.1\r\n") == len(pages) + len(names)
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "a" / names[0]).write_bytes((tmp_path / "a" / names[0]).read_bytes()[:-10])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, folders[0]).collect()
