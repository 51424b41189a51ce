import zlib

import numpy as np
from pyspark.sql import functions as F

from tracklake.llm import langid

WORDS = {"en": "the of and that with from have this they would".split(), "de": "der die und nicht mit von ist auf eine werden".split(), "xx": "ñandú qué çà être garçon où".split()}


def corpus(spark, n=240):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 12)), lang, 7))
    rows += [(n, None, "en", 1), (n + 1, "", "en", 1), (n + 2, "123 !?", None, 1), (None, "the of and that", None, 1), (n + 3, "und nicht " * 60_000, None, 1), (n + 3, "und nicht " * 60_000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_predictions_and_edges(spark):
    docs = corpus(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and truth[r["doc_id"]]]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in rows}
    for i in (240, 241, 242):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[243]["lang_pred"] == "de" and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)


def test_held_out_rows_teach_nothing(spark):
    docs = corpus(spark)
    lied = docs.withColumn("lang", F.when(langid.remainder() == 0, F.lit("lie")).otherwise(F.col("lang")))
    assert "lie" not in langid.train(lied).languages
    a, b = langid.train(docs), langid.train(lied)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf)


def brute_counts(text):
    """Buckets of all n-grams, one by one."""
    out, any_letter, folded = {}, False, " "
    for c in text:
        low = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        any_letter = any_letter or c.isalpha()
        folded += "" if low == " " and folded[-1] == " " else low
    folded += "" if folded[-1] == " " else " "
    for n in (1, 2, 3):
        for i in range(len(folded) - n + 1):
            h = 0
            for c in folded[i : i + n]:
                h = (h * 16777619 + ord(c)) % 2**32
            h = (h ^ (h >> 15)) * (2654435761, 2246822519, 3266489917)[n - 1] % 2**32
            out[h >> 17] = out.get(h >> 17, 0) + 1
    return out if any_letter else None


def test_predictions_against_brute_force(spark):
    docs = corpus(spark, 120).where("doc_id IS NULL OR doc_id < 122")
    model = langid.train(docs)
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    for r in docs.collect():
        found = brute_counts(r["text"] or "")
        if found is None:
            assert rows[r["doc_id"]] == ("und", 0.0)
            continue
        x = {b: (1 + np.log(n)) * model.idf[b] for b, n in found.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        z = np.array([sum(v / norm * float(model.weights[b, k]) for b, v in x.items()) for k in range(len(model.languages))]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[r["doc_id"]][0] == model.languages[int(p.argmax())] and abs(rows[r["doc_id"]][1] - p.max()) < 1e-6


def test_many_languages(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} text", f"l{i % 10 if i % 3 else 0}", 1) for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), max_languages=4)
    assert len(model.languages) == 4 and "l0" in model.languages


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).collect() == []
    bare = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(bare).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ünïcode  ab12cd, the END\n" * 50
    whole = langid.counts(text)
    for size in (3, 7, 64, len(text), len(text) + 1):
        monkeypatch.setattr(langid, "PIECE", size)
        assert np.array_equal(whole, langid.counts(text))
    assert langid.counts("12 34") is None


def test_penalties_make_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(5000, 40, replace=False)), np.full(40, 0.1), int(i % 2)) for i in range(200)]
    rows = [(np.append(at, 6000 + y), np.append(x, 0.7), y) for at, x, y in rows]
    dense, sparse = langid.ftrl(rows, 2, l1=0.0), langid.ftrl(rows, 2, l1=0.3)
    assert (sparse != 0).sum() < 0.2 * (dense != 0).sum() and sparse[6000, 0] > 0 > sparse[6000, 1]


def test_temperature_recovers_scale():
    rng = np.random.default_rng(2)
    true = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(true)])
    assert abs(langid.temperature(true * 4, labels) - 4) < 0.6
