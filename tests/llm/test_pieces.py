import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracklake.llm import pieces
from tracklake.llm.queries import PIECES

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MODEL = pieces.PieceModel(pieces.load(PIECES))
PARTS = [" ", "  ", "   ", "\n", "\t", "the", "re", "ation", "aaa", "bb", "é", "ß", "日本", "😀", "▁", "0", "123", "-", "==", "<s>", "<0x0A>", "​", "Q", "zz", "ing", "__", "....", "\r\n"]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), st.text(max_size=60)))
def test_same_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = MODEL.encode([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == text.replace(pieces.MARK, " ")


def test_survival_of_pairs_is_that_of_merges():
    rng = np.random.default_rng(1)
    vocabulary = [p for p in MODEL.ids if len(p) > 1 and "▁" not in p[1:]]
    for a, b in zip(rng.choice(vocabulary, 4000), rng.choice(vocabulary, 4000), strict=True):
        a, b = str(a), str(b).lstrip("▁") or "x"
        if MODEL.merged(a) == [a] and MODEL.merged(b) == [b]:
            assert MODEL.survives(a, b) == (MODEL.merged(a + b) == [a, b])


def unigram(vocabulary):
    """A unigram model file with these (piece, score)."""

    def field(n, value):
        if isinstance(value, bytes):
            return bytes([n << 3 | 2]) + varint(len(value)) + value
        if isinstance(value, float):
            return bytes([n << 3 | 5]) + struct.pack("<f", value)
        return bytes([n << 3]) + varint(value)

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    body = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for p, s in vocabulary:
        body += field(1, field(1, p.encode()) + field(2, float(s)))
    return body + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_unigram_viterbi():
    rng = np.random.default_rng(2)
    vocabulary = {c: -6.0 for c in "▁abc"}
    while len(vocabulary) < 40:
        vocabulary.setdefault("".join(rng.choice(list("abc"), rng.integers(2, 5))), float(-rng.integers(1, 90) / 7))
    model = pieces.PieceModel(unigram(vocabulary.items()))
    words = sorted({"▁" + "".join(rng.choice(list("abc"), rng.integers(1, 9))) for _ in range(60)})
    got = model.segment(words)

    def best(word):
        score = {0: 0.0}
        for i in range(1, len(word) + 1):
            score[i] = max(score[j] + model.scores[word[j:i]] for j in range(i) if word[j:i] in model.scores)
        return score[len(word)]

    for w in words:
        assert "".join(got[w]) == w and np.isclose(sum(model.scores[p] for p in got[w]), best(w))


def test_refused_models():
    bad = unigram([("a", -1.0), ("▁", -2.0), ("a▁", -3.0)])
    with pytest.raises(ValueError):
        pieces.PieceModel(bad)


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " a  b ", "x"), (3, " a  b ", "x"), (4, "word " * 60_000, "x"), (None, "日本 é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(df, pieces.load(PIECES))
    got = {r["doc_id"]: r["pieces"] for r in out.collect()}
    for i, t, _ in rows:
        assert got[i]["ids"] == LIBRARY.encode(t or "") and got[i]["round_trip"]
    back = pieces.decode(out.selectExpr("doc_id", "text", "pieces.ids AS piece_ids"), pieces.load(PIECES), "piece_ids", "back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert pieces.encode(df.limit(0), pieces.load(PIECES)).collect() == []
    assert hashlib.sha256(b"").hexdigest()


def test_known_words_take_no_room_again():
    m = pieces.PieceModel(pieces.load(PIECES))
    m.encode(["some plain words"])
    m.encode(["some plain words", "plain words", "some words"])
    assert m.held == sum(map(len, m.words))


def test_results_go_on_in_slices():
    texts = ["one two", None, "", "three  four\n", "é", "one", "two two two"]
    got = list(pieces.encoded(iter([pa.array(texts, pa.string()), pa.array([], pa.string()), pa.array(["five"])]), MODEL, 3))
    assert [len(g) for g in got] == [3, 3, 1, 0, 1]
    rows = [r for g in got for r in g.to_pylist()]
    assert [r["ids"] for r in rows] == [LIBRARY.encode(t or "") for t in [*texts, "five"]] and all(r["round_trip"] for r in rows)
    assert not MODEL.words and not MODEL.pairs
