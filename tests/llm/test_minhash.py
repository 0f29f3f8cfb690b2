import random

import numpy as np
import pytest
import zstandard

from tidemark.llm import minhash as op

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, percent):
    sets = []
    for _, text in docs:
        w = (text or "").translate(FOLD).split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    small = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((doc, len(sets[i]), small[find(i)], doc == small[find(i)]) for i, (doc, _) in enumerate(docs)), key=str)


def families(rng):
    docs, n = [], 1000
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            docs.append((n := n - 1, " ".join(words)))
            if rng.random() < 0.3:
                base = words  # chains drift away from where they began
    return docs


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(21)
    docs = families(rng) + [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "ONE  two"), (8, "one two"), (None, "one two"), (None, "solo words that nobody shares at all"), (12, "été " * 3000)]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node int, kept int").repartition(4)
    for size, percent in ((4, 80), (5, 80), (1, 90), (3, 50)):
        got = sorted((tuple(r) for r in op.near_duplicates(df, size=size, percent=percent).collect()), key=str)
        assert got == brute(docs, size, percent)
    kept = op.deduplicate(df)
    assert kept.columns == df.columns
    want = {r[0] for r in brute(docs, 5, 80) if r[3]}
    assert {r.doc_id for r in kept.collect()} == want


def test_links_between_members_of_a_bucket_are_found_without_its_first(spark):
    texts = [" ".join(f"t{i // 2}w{k}" for k in range(60)) + (" more" if i % 2 else "") for i in range(60)]
    marks = op.signatures(op.shingle_sets(texts, 4)).astype("u1")
    name = lambda i: bytes([i]) * 16
    nodes = spark.createDataFrame([(name(i), bytearray(marks[i].tobytes())) for i in range(60)], "node binary, sketch binary")
    packed = spark.createDataFrame([(name(i), bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(texts)], "node binary, packed binary")
    # Buckets 7, 9 and 10 hold all; 8 holds one pair, with a third member of no likeness.
    rows = [(7 + 2 * (p > 0) + (p > 1), p, name(i), 57) for i in range(60) for p in (0, 1, 2)] + [(8, 3, name(k), 57) for k in (0, 1, 9)]
    members = spark.createDataFrame(rows, "band long, pos int, node binary, n_shingles long")
    roots = spark.createDataFrame([(name(5), name(4))], "node binary, root binary")
    for hot, block in ((4, 1 << 20), (59, 200), (60, 200), (60, 1 << 20)):
        found = {(r.a[0], r.b[0]) for r in op._hidden_links(members, roots, nodes, packed, 4, 80, hot, block).collect()}
        assert found == {(i, i + 1) for i in range(0, 60, 2) if i != 4}


def test_bands_follow_the_threshold_and_lose_next_to_nothing():
    rng = np.random.default_rng(5)
    assert op.banding(80) == (32, 4) and op.banding(100) == (1, 128)
    for percent in (15, 30, 50, 80, 90, 95):
        bands, rows = op.banding(percent)
        assert bands * rows <= 128 and (1 - (percent / 100) ** rows) ** bands <= 1e-6
        found = far = 0
        for _ in range(400):  # pairs exactly at the threshold: 200 shingles in the union
            union = rng.integers(0, 1 << 63, 200, dtype="u8")
            own = (200 - 2 * percent) // 2
            sets = [np.unique(union[: 2 * percent + own]), np.unique(np.concatenate([union[: 2 * percent], union[2 * percent + own :]]))]
            minima = op.signatures(sets)
            keys = op.band_keys(minima, bands, rows)
            found += bool((keys[0] == keys[1]).any())
            far += (minima[0] == minima[1]).mean() < op.least_agreement(percent)
        assert found == 400 and far == 0
    with pytest.raises(ValueError, match="minima"):
        op.banding(10)


def test_a_hot_bucket_of_unlike_documents_is_refined(spark, monkeypatch):
    """A passage that all share makes buckets of all; only the planted pairs are linked, and none is lost."""
    monkeypatch.setattr(op._hidden_links, "__defaults__", (12, 1 << 21))
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(60)]
    docs = []
    for i in range(60):
        own = [f"d{i}w{k}" for k in range(30)]
        docs.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            own[rng.randrange(30)] = "changed"
            docs.append((2 * i + 1, " ".join(passage + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in op.near_duplicates(df, size=3, percent=80).collect()), key=str) == brute(docs, 3, 80)


def test_a_pair_that_shares_one_hot_bucket_only_is_found(spark):
    """Of documents that agree in most of their shingles, but link to none, two are alike; they meet in a single bucket, which is hot."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(70)]
    texts = [" ".join([*common, *(f"o{i}w{k}" for k in range(30))]) for i in range(40)]
    texts[31] = " ".join([*common, *(f"o5w{k}" for k in range(24)), *(f"x{k}" for k in range(6))])
    order = rng.sample(range(40), 40)
    name = lambda i: bytes([order[i]]) * 16
    sets = op.shingle_sets(texts, 3)
    marks = op.signatures(sets).astype("u1")
    nodes = spark.createDataFrame([(name(i), bytearray(marks[i].tobytes())) for i in range(40)], "node binary, sketch binary")
    packed = spark.createDataFrame([(name(i), bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(texts)], "node binary, packed binary")
    members = spark.createDataFrame([(7, 11, name(i), len(sets[i])) for i in range(40)], "band long, pos int, node binary, n_shingles long")
    roots = spark.createDataFrame([(name(3), name(2))], "node binary, root binary")
    for hot in (4, 38, 1000):
        found = {frozenset((bytes(r.a), bytes(r.b))) for r in op._hidden_links(members, roots, nodes, packed, 3, 80, hot).collect()}
        assert found == {frozenset((name(5), name(31)))}


def test_rare_shingles_first(spark, monkeypatch):
    monkeypatch.setattr(op, "RARE", 600)
    texts = [" ".join([*(f"c{k}" for k in range(90)), *(f"o{i}w{k}" for k in range(30))]) for i in range(20)]
    sets = op.shingle_sets(texts, 1)
    nodes = spark.createDataFrame([(bytes([i]) * 16, bytes([i]) * 16, 120, bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(texts)], "node binary, root binary, n_shingles long, packed binary")
    got = op._by_rare_shingles(nodes, 1, 80).toPandas()
    shared = set(sets[0].view("i8")) & set(sets[1].view("i8"))
    assert len(shared) == 90 and (got.groupby("node").size() == 25).all() and not shared & set(got.token)


def test_star_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(35)] + [(200, 200 + k) for k in range(1, 40)]
    found = {r.node: r.root for r in op.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if n != r}


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
