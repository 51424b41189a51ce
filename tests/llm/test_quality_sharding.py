import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import quality, sharding


def brute(text):
    text = text or ""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    w = [text[a:b] for a, b in words]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(dup), sum(map(len, dup))]
    chars = []
    for n in range(5, 11):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
        if n == 5:
            out.append(len(inside))
        chars.append(sum(len(w[j]) for j in inside))
    return out + chars


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "d#", "é", "\n", " ", "\t", "a b a b a b\n", "\x0b", " ", "&<", "\x1c"]), max_size=60).map(" ".join))
def test_measures(text):
    assert quality.measure(text) == brute(text)


def test_quality_table(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, 9), (2, "", 9), (3, clean, 9), (3, clean, 9), (4, "five words again and again " * 10, 9), (5, clean * 3000, 9), (None, clean, 9), (6, "short text", 9)]
    df = quality.repetition(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), "text", "m")
    got = [(r[0], r[1], r[2]) for r in df.select("doc_id", quality.base_failed(df["m"]), quality.kept(df["m"])).collect()]
    assert sorted(got, key=str) == sorted([(1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False), (5, True, False), (None, False, True), (6, True, False)], key=str)
    assert quality.repetition(df.limit(0).select("doc_id", "text")).collect() == []


def test_matrix_margins():
    blocks = {i: int(n) for i, n in enumerate(np.random.default_rng(1).integers(0, 900, 40))}
    m = sharding.matrix(blocks, 24, 5)
    total = sum(blocks.values())
    columns = np.sum(list(m.values()), axis=0)
    assert all(sum(m[b]) == n for b, n in blocks.items()) and columns.sum() == total and columns.max() - columns.min() <= 1
    assert m == sharding.matrix(blocks, 24, 5) and m != sharding.matrix(blocks, 24, 6)


def test_matrix_is_hypergeometric():
    draws = np.array([[sharding.matrix({0: 50, 1: 150}, 4, s)[0][k] for k in range(4)] for s in range(4000)])
    mean, var = draws.mean(axis=0), draws.var(axis=0)
    expected = 50 * 0.25 * 0.75 * (200 - 50) / 199
    assert np.allclose(mean, 12.5, atol=0.25) and np.allclose(var, expected, rtol=0.12)


def test_draws_beyond_numpys_range():
    rng = np.random.default_rng(2)
    # three of 10**10 rows, a tenth of them good: all but binomial
    got = np.bincount([sharding._hypergeometric(rng, 10**9, 9 * 10**9, 3) for _ in range(6000)], minlength=4) / 6000
    assert np.allclose(got, [0.729, 0.243, 0.027, 0.001], atol=0.025)
    draws = np.array([sharding._hypergeometric(rng, 10**9, 23 * 10**9, 50_000) for _ in range(4000)])
    assert abs(draws.mean() - 50_000 / 24) < 4 and np.isclose(draws.var(), 50_000 / 24 * 23 / 24, rtol=0.12)
    # the law itself where it can be counted
    for good, bad, n in ((7, 5, 6), (3, 40, 20), (40, 3, 20), (1, 1, 1), (5, 2, 7)):
        want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
        got = np.bincount([sharding._inverted(rng, good, bad, n) for _ in range(6000)], minlength=n + 1) / 6000
        assert np.allclose(got, want, atol=0.03)
    blocks = {0: 3 * 10**9, 1: 2 * 10**9, 2: 5}
    m = sharding.matrix(blocks, 3, 1)
    columns = np.sum(list(m.values()), axis=0)
    assert all(sum(m[b]) == n and min(m[b]) >= 0 for b, n in blocks.items()) and columns.max() - columns.min() <= 1


def test_shards(spark):
    rows = [(i, f"text {i} é", 3) for i in range(1000)] + [(2000, None, 1), (2001, "", 1), (2002, "x" * 400_000, 1), (None, "n", 1)] + [(3000, "same", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(df, rows_per_block=90).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(24)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    texts = {i: t or "" for i, t, _ in rows}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "rows" for r in got)
    again = sharding.shard_documents(df.repartition(7), rows_per_block=90).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(df.limit(0)).collect() == []
    # many ranges within a shard still give gapless slots
    from pyspark.sql import functions as F

    small = sharding.shard_rows(df.select("doc_id"), 3, [F.col("doc_id")], rows_per_block=100, rows_per_range=40).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in small if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_matrix_drawn_in_two_steps_has_the_same_law():
    # a group's row, drawn apart into its blocks' rows, against the blocks drawn at once
    def apart(seed):
        top = sharding.matrix({0: 60, 1: 140}, 4, (seed, 0))
        return sharding.matrix({0: 50, 2: 10}, 4, (seed, 1), top[0])[0]

    draws = np.array([apart(s) for s in range(4000)])
    assert np.allclose(draws.mean(axis=0), 12.5, atol=0.25) and np.allclose(draws.var(axis=0), 50 * 0.25 * 0.75 * 150 / 199, rtol=0.12)
    top = sharding.matrix({0: 60, 1: 140}, 4, 3)
    below = sharding.matrix({0: 50, 2: 10}, 4, 9, top[0])
    assert np.sum(list(below.values()), axis=0).tolist() == top[0] and [sum(below[b]) for b in (0, 2)] == [50, 10]


def test_a_value_that_a_third_of_the_rows_has(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, "t") for i in range(1200)] + [(-1, "t")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(sharding, "GROUP", 3)  # many groups of blocks
    seen = []
    real = sharding.store
    monkeypatch.setattr(sharding, "store", lambda t: seen.append(real(t)) or seen[-1])
    out = sharding.shard_rows(df, 5, [F.col("doc_id")], rows_per_block=100, rows_per_range=50)
    got = sorted((r["doc_id"], r["shard"], r["slot"]) for r in out.collect())
    sizes = [r["_n"] for r in seen[-2].collect()]  # the counts of the blocks, last taken
    assert sum(sizes) == 1800 and max(sizes) < 200
    for s in range(5):
        assert sorted(x[2] for x in got if x[1] == s) == list(range(360))
    spread = [sum(x[0] == -1 and x[1] == s for x in got) for s in range(5)]
    assert sum(spread) == 600 and min(spread) > 80
    again = sharding.shard_rows(df.repartition(5), 5, [F.col("doc_id")], rows_per_block=100, rows_per_range=50)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.collect()) == got


def test_documents_against_brute_force(spark):
    """Blocks, the matrix, ranks and slots once more in plain Python, from Spark's hashes of each row."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i % 50}" if i % 7 else None) for i in range(900)], "doc_id long, text string")
    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in docs.collect()}
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 8 for r in docs.collect()}
    keys = spark.createDataFrame([(i, crc[i], size[i]) for i in crc], "doc_id long, crc long, size long").select("doc_id", F.xxhash64(F.lit(7), "doc_id", "crc", "size").alias("a"), F.xxhash64(F.lit(8), "doc_id", "crc", "size").alias("b"))
    keys = keys.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "a", "b"), F.lit(9))).collect()
    blocks = {}
    for r in keys:
        blocks.setdefault(r["block"], []).append((r["a"], r["b"], r["doc_id"]))
    top = sharding.matrix({0: 900}, 24, 7)
    counts = sharding.matrix({b: len(v) for b, v in blocks.items()}, 24, (7, 0), top[0])
    shards = {}
    for b, v in blocks.items():
        order = sorted(v)
        for s in range(24):
            for a, c, i in order[: counts[b][s]]:
                shards.setdefault(s, []).append(((c % 2**64) >> 1, c, a, i))
            order = order[counts[b][s] :]
    want = {}
    for s, v in shards.items():
        for n, x in enumerate(sorted(v, key=lambda x: x[1:3])):
            want[x[3]] = (s, n)
    got = {r["doc_id"]: (r["shard"], r["slot"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in sharding.shard_documents(docs, rows_per_block=100).collect()}
    assert got == {i: (*want[i], size[i], crc[i], "rows", None) for i in want}
