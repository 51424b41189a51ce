import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from tracklake.llm import mixing


def fill(children, given):
    """(name, capacity, weight) -> budgets, by rounds: saturated children leave, the rest share again."""
    out, left, open_ = {}, given, [c for c in children if c[2] > 0]
    out.update({c[0]: 0 for c in children if c[2] == 0})
    while open_:
        total = sum(c[2] for c in open_)
        full = [c for c in open_ if c[1] * total <= c[2] * left]
        if not full:
            out.update({c[0]: min(c[1], c[2] * left // total) for c in open_})
            break
        full.sort(key=lambda c: (c[1] / c[2], c[0]))
        c = full[0]
        out[c[0]], left = c[1], left - c[1]
        open_.remove(c)
    return out


def brute(rows, weights, percent, epochs, seed, domain=lambda source: "d" + (source or "unknown")[-1]):
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    tree = collections.defaultdict(lambda: collections.defaultdict(dict))
    docs = collections.defaultdict(list)
    for i, t, lang, source in rows:
        leaf = (domain(source), lang or "unknown", source or "unknown")
        docs[leaf].append((i, words(t)))
    for leaf, ds in docs.items():
        tree[leaf[0]][leaf[1]][leaf[2]] = sum(n for _, n in ds) * epochs
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    whole = sum(n for ds in docs.values() for _, n in ds)
    cap = lambda x: sum(map(cap, x.values())) if isinstance(x, dict) else x
    budget = fill([(d, cap(t), w("domain", d)) for d, t in tree.items()], min(whole * percent // 100, cap(tree)))
    got = {}
    for d, t in tree.items():
        b1 = fill([(x, cap(u), w("lang", x)) for x, u in t.items()], budget[d])
        for x, u in t.items():
            b2 = fill([(s, c, w("source", s)) for s, c in u.items()], b1[x])
            for s in u:
                ds, b = docs[d, x, s], b2[s]
                n = sum(k for _, k in ds)
                passes = b // n if n else 0
                rest = b - passes * n
                order = sorted(ds, key=lambda r: (hashlib.md5(f"{seed}|{passes}|{r[0]}".encode()).hexdigest(), r[1]))
                for i, k in order:
                    take = min(k, rest) if rest > 0 else 0
                    done = rest > 0 and take == k
                    got[i] = (passes + int(done), 0 if done else take)
                    rest -= take
    return got


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["en"] * 6 + ["de", "fr", None]), rng.choice(["s0"] * 8 + ["s1", "s2", "s3", "s4", None])) for i in range(700)]
    rows += [(700, None, "en", "s0"), (701, "x " * 30_000, "de", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("passes", F.lit(1)).withColumn("leaf", F.lit("z"))
    domain = F.concat(F.lit("d"), F.substring(F.coalesce("source", F.lit("unknown")), -1, 1))
    for weights, percent, epochs in (({"domain": {"d0": 5, "d1": 1}, "lang": {"en": 1, "fr": 6}}, 50, 2), ({"domain": {"d0": 1, "d4": 90, "d2": 0}}, 80, 1), ({}, 100, 3), ({}, 0, 1)):
        out = mixing.mix(df, domain, weights, percent, epochs, seed=4)
        assert set(df.columns) <= set(out.columns)
        got = {r["doc_id"]: (r["copies"], r["prefix_tokens"]) for r in out.select("doc_id", "_mix.*").collect()}
        assert got == brute(rows, weights, percent, epochs, 4)


def test_equal_rows_share_what_is_left(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ten = "w " * 10
    for ident in (1, None):
        got = [tuple(r["_mix"])[4:] for r in mixing.mix(docs([(ident, ten, "en", "s1")] * 6), F.lit("d"), {}, 25, 1).collect()]
        assert sorted(got) == [(0, 0)] * 4 + [(0, 5), (1, 0)]
    # equal ids and sizes, different texts: always the same ones are taken
    rows = [(1, f"w{i} " * 10, "en", "s1") for i in range(9)] + [(2, "x " * 7, "en", "s1"), (3, None, "en", None), (4, "a b c", "en", None)]
    once = [sorted(map(str, mixing.mix(docs(rows).repartition(n), mixing.number_domain(), {}, 40, 1, rows_per_range=2).collect())) for n in (1, 5)]
    assert once[0] == once[1]
    taken = mixing.mix(docs(rows), mixing.number_domain(), {}, 40, 1).selectExpr("sum(_mix.copies * _mix.n_tokens + _mix.prefix_tokens)").first()[0]
    assert 40 - 2 <= taken <= 40
    assert {(r["source"], r["_mix"]["domain"]) for r in mixing.mix(docs(rows), mixing.number_domain(), {}).collect()} == {("s1", "books"), (None, "unknown")}


def test_sql_with_null_sources(spark, tmp_path):
    import duckdb

    from tracklake.llm import queries

    rng = random.Random(9)
    rows = [(i if i % 7 else None, " ".join("w" * rng.randint(1, 3) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", "named", None])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["op10_mixing"](spark, str(tmp_path)).collect()
    names = ["doc_id", "domain", "lang", "source", "n_tokens", "copies", "prefix_tokens"]
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == sorted(map(str, con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op10_mixing']})").fetchall()))


def test_first_tokens(spark):
    row = spark.createDataFrame([(" a\tb  \u00a0c\n d ",)], "t string").select(*[mixing.first_tokens(F.col("t"), F.lit(n)) for n in (1, 3, 9)]).first()
    assert tuple(row) == (" a", " a\tb  \u00a0c", " a\tb  \u00a0c\n d")


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df, F.lit("d"), {}).collect() == []
    one = spark.createDataFrame([(None, None, None, None), (1, "", "", "")], "doc_id long, text string, lang string, source string")
    assert [r["_mix"]["copies"] for r in mixing.mix(one, F.lit(None).cast("string"), {}).collect()] == [0, 0]
