import random

import numpy as np

from tracklake.llm import neardup as N
from tracklake.llm.words import word_bounds, code_points

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent=80):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0

    def add(t):
        nonlocal i
        rows.append((i, t))
        i += 1

    for _ in range(60):
        add(" ".join(rng.choices(words, k=rng.randint(1, 200))))
    base = rng.choices(words, k=150)
    for _ in range(120):  # a group of near copies of one text, at all distances
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        add(" ".join(t))
    chain = rng.choices(words, k=120)
    for _ in range(25):  # each near the one before, far from the first
        chain = chain[4:] + rng.choices(words, k=4)
        add(" ".join(chain))
    passage = rng.choices(words, k=60)
    for _ in range(60):
        add(" ".join(passage + rng.choices(words, k=40)))
    for _ in range(40):
        add("Exact  COPY of\n a text")
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "long " + " ".join(rng.choices(words, k=60_000)))]


def test_against_brute_force(spark):
    for k in (4, 5):
        rows = corpus(k)
        docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n long")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, k).collect()}
        assert got == brute(rows, k)
        kept = {r["doc_id"] for r in N.keep_one(docs, k).collect()}
        assert kept == {i for i, (_, c) in got.items() if c == i}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u v"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in N.near_duplicates(docs, 4).collect())
    assert got == [(-1, -1), (2, 2), (5, 2), (5, 2), (7, 2), (7, 7)]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in N.keep_one(docs, 4).collect())
    assert kept == [(-1, "a b c d e f"), (2, "a b c d e f"), (7, "q r s t u v")]
    # an id's other text is never compared in place of the class's own
    twice = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "k l m n o p q r s t u"), (3, "A b c d e f g h i j z")], "doc_id long, text string")
    assert sorted(tuple(r) for r in N.near_duplicates(twice, 4).collect()) == [(1, 7, 1), (1, 7, 1), (2, 8, 1), (3, 8, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).collect() == [] and N.keep_one(empty).collect() == []


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(6)
    a, b = (rng.integers(0, 2**63, size=n).astype(np.uint64) for n in (3000, 800))
    assert np.array_equal(N.sketch(np.concatenate((a, b))), N.merge(N.sketch(a), N.sketch(b)))
    for j in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            n = 2000
            both = int(round(2 * n * j / (1 + j)))
            x = rng.integers(0, 2**63, size=2 * n - both).astype(np.uint64)
            one, two = x[:n], x[n - both :]
            e = N.estimate(np.array([n]), N.sketch(one)[None].astype(np.int64), np.array([n]), N.sketch(two)[None].astype(np.int64))[0]
            errors.append(e - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    single = N.sketch(np.array([5], np.uint64))
    assert single.shape == (N.M,) and (single > 0).all()


def test_words():
    s, e = word_bounds(code_points(" a\tbc\x0bd  "))
    assert [(int(a), int(b)) for a, b in zip(s, e, strict=True)] == [(1, 2), (3, 5), (6, 7)]


def test_a_pair_is_given_by_its_first_shared_band(spark):
    rows = [([1, 2, 3], [9, 2, 3]), ([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [4, 5, 6])]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(N.first_shared("a", "b", 3).alias("k")).collect()
    assert [r["k"] for r in got] == [2, 1, None]
