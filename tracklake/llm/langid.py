"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 characters of the lower-cased letters (all else is one space), hashed into
BUCKETS; weight (1 + log tf) * idf, each document scaled to length 1. Document frequencies come from all
learnable rows. The weights are trained by follow-the-regularised-leader (per-coordinate FTRL-proximal)
with L1 and L2 penalties on a sample of ``rows_per_language`` expected rows of each language, picked by a
hash; a fifth of the sample sets the temperature that calibrates the probabilities and trains nothing. Of more
than ``max_languages`` values of lang the most frequent are learned, of equally frequent ones the first in order.

What reaches the driver: one count per language, BUCKETS document frequencies, and the sample's sparse
vectors (at most BUCKETS entries a row). Texts are read whole, in pieces of bounded memory.

Defined results: ``und`` with score 0 for a null text, one without a letter, or when nothing can be
learned; ties go to the language first in order; repeated rows are judged alike; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
PIECE = 1 << 20
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_BASE = np.uint32(16777619)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it counts as (lower-cased letter, else a space), and whether it's a letter."""
    letter = np.zeros(0x110000, bool)
    folded = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            folded[i] = ord(low) if len(low) == 1 else i
    return folded, letter


def counts(text: str) -> np.ndarray | None:
    """How often each bucket occurs in the text; None without a letter."""
    folded, letter = _tables()
    out, tail, any_letter = np.zeros(BUCKETS, np.int64), np.full(1, 32, np.uint32), False
    for i in range(0, len(text) + 1, PIECE):  # pieces overlap by what an n-gram can span
        points = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        any_letter = any_letter or bool(letter[points].any())
        last = i + PIECE > len(text)
        fresh = np.concatenate((folded[points], np.full(int(last), 32, np.uint32)))
        both = np.concatenate((tail, fresh))
        keep = np.ones(both.size, bool)
        keep[1:] = (both[1:] != 32) | (both[:-1] != 32)
        keep[: tail.size] = True
        x = both[keep]
        old = tail.size
        for n in range(1, ORDERS + 1):
            if x.size < n:
                continue
            h = np.zeros(x.size - n + 1, np.uint32)
            for k in range(n):
                h = h * _BASE + x[k : x.size - n + 1 + k]
            h = h[max(0, old - n + 1 if i else 0) :]  # n-grams that lie in the part seen before are counted
            h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[n - 1]
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=BUCKETS)
        tail = x[-(ORDERS - 1) :] if x.size >= ORDERS else x
    return out if any_letter else None


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document's TF-IDF vector of length 1."""
    at = np.flatnonzero(found)
    x = (1 + np.log(found[at])) * idf[at]
    norm = math.sqrt(float(x @ x))
    return at, x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if text and self.languages else None
        if found is None:
            return "und", 0.0
        at, x = vector(found, self.idf)
        p = softmax((x @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 5) -> np.ndarray:
    """Weights (BUCKETS, classes) after FTRL-proximal passes over rows (buckets, values, class)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, label = rows[i]
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / math.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    lo, hi, ratio = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, np.int64)
    rows = 0
    for batch in batches:
        for t in batch.column(0):
            found = counts(t.as_py())
            if found is not None:
                df += found > 0
                rows += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for lang, part, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = counts(t)
            if found is not None:
                at = np.flatnonzero(found)
                out.append((lang, part, at.astype(np.uint16).tobytes(), np.minimum(found[at], 2**31 - 1).astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["lang", "part", "at", "tf"])


def train(docs: DataFrame, rows_per_language: int = 1000, seed: int = 11, max_languages: int = 1000) -> Model:
    """A model learned from the rows of docs (doc_id, text, lang) that aren't held out."""
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(remainder() != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    frequencies = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r["bucket"]: r["n"] for r in frequencies.collect()}
    total = found.pop(-1, 0)
    df = np.zeros(BUCKETS)
    df[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + df)) + 1
    if not total:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = F.coalesce(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])[F.col("lang")], F.lit(0.0))
    sample = rows.where(F.shiftrightunsigned(order, 11) < share * 2.0**53).select("lang", F.pmod(order, F.lit(1 << 20)).alias("part"), "text")
    got = sorted(map(tuple, sample.mapInArrow(_vectors, "lang string, part long, at binary, tf binary").collect()))
    languages = sorted({r[0] for r in got})
    place = {x: i for i, x in enumerate(languages)}
    learn, check = [], []
    for lang, part, at, tf in got:
        full = np.zeros(BUCKETS, np.int64)
        full[np.frombuffer(at, np.uint16)] = np.frombuffer(tf, np.int32)
        (check if part % 5 == 0 else learn).append((*vector(full, idf), place[lang]))
    weights = ftrl(learn, len(languages))
    logits = np.array([x @ weights[at] for at, x, _ in check]).reshape(len(check), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(logits, np.array([c for *_, c in check], int)))


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column ``out`` of lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return df.withColumn(out, run(F.col(text)))


def identify(docs: DataFrame, rows_per_language: int = 1000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, rows_per_language)
    rows = predict(docs.select("doc_id", "text", (remainder() == 0).alias("held_out")), model)
    return rows.select("doc_id", "held_out", "language.lang_pred", "language.score")
