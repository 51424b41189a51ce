import random

import corpus_pipeline as C
from test_mixing import brute as mixed
from test_neardup import brute as near
from test_quality_sharding import brute as measured

from tracklake.llm import mixing, pieces, quality, secretscan
from tracklake.llm.queries import PIECES


def passes(text):
    m = dict(zip(quality.FIELDS, measured(text), strict=True))
    if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]:
        return False
    ok = m["dup_line_chars"] <= quality.LINE_CHAR_LIMIT * m["word_chars"] and m["n_dup_lines"] <= quality.LINE_LIMIT * m["n_lines"]
    return ok and all(m[f"dup_chars_{n}"] <= x * m["word_chars"] for n, x in quality.NGRAM_LIMITS.items())


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(220):
        t = " ".join(rng.choices(words, k=rng.randint(3, 60)))
        if i % 5 == 0:
            t += ' token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"'
        if i % 11 == 0:
            t = t + " and so on and on it goes" * 8
        rows.append((i, t, rng.choice(["en", "de", None]), f"src{rng.randint(0, 5)}", len(t)))
    rows += [(300 + i, rows[3][1], "en", "src1", 1) for i in range(20)] + [(400, None, "en", "src1", None), (401, "", None, None, 0), (402, " ".join(words[:50]), None, None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {r[0]: r for r in rows}
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        got = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == C.COLUMNS
        if k == 0:
            now = {i: r for i, r in now.items() if passes(r[1])}
            assert set(got) == set(now)
        elif k == 1:
            groups = near([(i, r[1]) for i, r in now.items()], 5)
            now = {i: r for i, r in now.items() if groups[i][1] == i}
            assert set(got) == set(now)
        elif k == 2:
            assert set(got) == set(now)
            assert all(not secretscan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in got.values())
            assert all(got[i]["text"] == r[1] for i, r in now.items() if "token" not in r[1])
            now = {i: (i, r["text"], r["lang"], r["source"], r["n_chars"]) for i, r in got.items()}
        elif k == 3:
            domain = lambda s: ["web", "books", "code"][int(s[3:]) % 3] if s else "unknown"
            want = mixed([r[:4] for r in now.values()], mixing.WEIGHTS, 90, 1, 19, domain)
            assert set(got) == {i for i, (copies, first) in want.items() if copies or first}
            for i, r in got.items():
                n = want[i][1] or len(now[i][1].split())
                assert r["text"].split() == now[i][1].split()[:n] and now[i][1].startswith(r["text"])
                assert r["n_chars"] == len(r["text"]) or not want[i][1]
            now = {i: (i, r["text"]) for i, r in got.items()}
        else:
            model = pieces.PieceModel(pieces.load(PIECES))
            assert all(r["round_trip"] and model.decode(r["ids"]) == now[i][1] for i, r in got.items())
    whole = C.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
