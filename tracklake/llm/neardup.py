"""Near-duplicate documents by SetSketch registers, banded, estimated by joint likelihood, then verified.

A document is the set of its distinct word shingles, as 64-bit hashes. Its sketch has M registers: every
element sends exponential arrivals to random registers, a register keeps the earliest arrival x, stored as
the truncated floor(1 - log_B(x)). Sketches merge by the register-wise maximum, and two sets agree in a
register with about the probability of their Jaccard similarity. Arrivals are generated in rising order
and stop at the latest register, so a sketch costs about n + M log M operations.

1. Equal sets are one class (a hash of the set, combined before the shuffle), however many copies exist.
2. Bands of ROWS registers are bucket keys. In each bucket every class is a candidate of the bucket's
   smallest class: as many pairs as members, never all pairs of a bucket.
3. A candidate stays if the sizes allow the similarity and the joint likelihood of the registers puts the
   estimate above a margin under it; then the full sets are compared.
4. Connected components of the links. Buckets that still hold several components are looked at once more:
   there, pairs of classes of different components are candidates, which the same steps decide. Pairs
   inside a component need no look. Of the others, the join passes only those whose hash bitmaps differ in
   no more bits than similar sets can: the differing bits never outnumber the differing elements, so this
   drops no link, and a group of texts that are near but not similar gives few rows.

A pair of similarity 0.8 shares no band with probability (1 - 0.8**ROWS)**BANDS, under 3e-6.

Defined results: documents without text or words have no shingle, link with nothing and are their own
component; repeated rows with the same doc_id and text are one document, which stays or goes with all its rows;
of texts that share a doc_id each is judged by itself; a null doc_id has a null component and is kept; an empty
table gives an empty result. near_duplicates() returns three columns whatever others there are; keep_one() returns
all columns of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import components
from .shared import drop, rekey, store

M, ROWS, BANDS = 256, 6, 42
#: Base of the register scale, rate of the arrivals, largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: The estimate's standard error at 0.8 is 0.025; candidates over five of them lower are dropped.
MARGIN = 0.13
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap that stands behind the registers.
BITS = 2048


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; fewer than k words are one shingle."""
    points = W.fold_ascii(W.code_points(text or ""))
    hashes = W.word_hashes(points, *W.word_bounds(points))
    if not hashes.size:
        return hashes
    n = min(k, hashes.size)
    return np.unique(W.mix(W.window_hashes(hashes, n) + np.uint64(n)))


def sketch(elements: np.ndarray) -> np.ndarray:
    """The M registers of a non-empty set of 64-bit hashes."""
    first = np.full(M, np.inf)
    at, time, done = elements, np.zeros(elements.size), 0
    steps = max(1, math.ceil(M * (math.log(M) + 1) / elements.size))
    while at.size:
        turn = (np.arange(done + 1, done + steps + 1, dtype=np.uint64) * _GOLD)[None, :]
        events = W.mix(at[:, None] + turn)
        waits = -np.log(((events >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
        times = time[:, None] + np.cumsum(waits, axis=1)
        np.minimum.at(first, (events & np.uint64(M - 1)).astype(np.int64).ravel(), times.ravel())
        going = times[:, -1] < first.max()  # later arrivals of the others can't be the earliest anywhere
        at, time, done = at[going], times[going, -1], done + steps
        steps = max(1, steps // 4)
    return np.clip(np.floor(1 - np.log(first / RATE) / math.log(BASE)), 0, TOP).astype(np.uint16)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """BITS bits, each set where an element's hash falls, as 16-bit numbers."""
    seen = np.zeros(BITS, np.uint8)
    seen[(elements >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(seen).view(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys of (rows, M) registers."""
    bands = registers[:, : ROWS * BANDS].reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(ROWS):
        keys = W.mix(keys * _GOLD + bands[:, :, i])
    return keys.view(np.int64)


def estimate(na: np.ndarray, ra: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the Jaccard similarity from how often a's register is larger, smaller or equal.

    With u and v the sizes' shares, a's register is the larger with probability p(u - vJ), b's with
    p(v - uJ), where p(x) = -log_B(1 - x (B - 1) / B). The likelihood is concave in J: a fine grid suffices.
    """
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    above, below = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more * log(above) + less * log(below) + (M - more - less) * log(1 - above - below)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


_SKETCH = T.StructType([T.StructField(c, t) for c, t in (("n", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("registers", T.BinaryType()), ("bits", T.BinaryType()))])


def _identity(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set, which stand for it."""
    h1, h2 = int(W.mix(s).sum(dtype=np.uint64)), int(W.mix(s ^ _GOLD).sum(dtype=np.uint64))
    return h1 - 2**63, h2 - 2**63


def _sketches(k: int):
    @F.arrow_udf(_SKETCH)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingles(t.as_py(), k)
                rows.append((s.size, *_identity(s), sketch(s).tobytes(), bitmap(s).tobytes()) if s.size else (0, 0, 0, b"", b""))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], ["n", "h1", "h2", "registers", "bits"])

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), M)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bitmaps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        bits = np.frombuffer(b"".join(column.to_pylist()), np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, BITS // 64, dtype=np.int32)), pa.array(bits))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        keys = band_keys(_registers(column))
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))


@F.arrow_udf(T.DoubleType())
def _estimates(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for na, ra, nb, rb in batches:
        yield pa.array(estimate(na.to_numpy(), _registers(ra), nb.to_numpy(), _registers(rb)) if len(na) else np.empty(0))


def _common(k: int):
    """How many elements two texts' sets share; -1 if one of the texts isn't the one that its class stands for."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kept: dict[str, tuple[np.ndarray, int]] = {}

        def known(text: str) -> tuple[np.ndarray, int]:
            s = shingles(text, k)
            return s, _identity(s)[0]

        for one, first, other, second in batches:
            out = []
            for a, ha, b, hb in zip(one, first, other, second, strict=True):
                a = a.as_py() or ""
                if a not in kept:
                    kept = {a: known(a)}  # rows come ordered by the bucket's smallest class
                x, y = kept[a], known(b.as_py())
                out.append(np.intersect1d(x[0], y[0], assume_unique=True).size if (x[1], y[1]) == (ha.as_py(), hb.as_py()) else -1)
            yield pa.array(out, pa.int64())

    return run


def first_shared(one: str, other: str, bands: int = BANDS) -> Column:
    """The key of the first band in which two arrays of keys agree; null without any."""
    return F.expr("coalesce(" + ", ".join(f"if({one}[{i}] = {other}[{i}], {one}[{i}], NULL)" for i in range(bands)) + ")")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """The pairs (c, cid) whose full sets are similar enough."""
    one = classes.select(F.col("cid").alias("c1"), F.col("n").alias("na"), F.col("registers").alias("ra"), F.col("h1").alias("ha"), F.col("rep").alias("rep_a"))
    two = classes.select(F.col("cid").alias("c2"), F.col("n").alias("nb"), F.col("registers").alias("rb"), F.col("h1").alias("hb"), F.col("rep").alias("rep_b"))
    near = pairs.join(two, pairs["cid"] == two["c2"]).drop("c2").join(one, pairs["c"] == one["c1"]).drop("c1")
    near = near.where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    near = near.withColumn("j", _estimates("na", "ra", "nb", "rb")).where(F.col("j") >= percent / 100 - MARGIN)
    near = store(near.select("c", "cid", "na", "nb", "ha", "hb", "rep_a", "rep_b"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("t"))
    both = near.join(texts.withColumnsRenamed({"id": "id_b", "t": "text_b"}), F.col("rep_b") == F.col("id_b"))
    both = both.join(texts.withColumnsRenamed({"id": "id_a", "t": "text_a"}), F.col("rep_a") == F.col("id_a"))
    both = both.withColumn("common", _common(k)("text_a", "ha", "text_b", "hb")).where("common >= 0")
    both = both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common")))
    out = store(both.select(F.col("c").alias("a"), F.col("cid").alias("b")).distinct())
    del both
    drop(near, shuffles=True)
    return out


def _judged(docs: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """For each row of docs its doc_id, a hash of its text (mark), n_shingles and component_id."""
    sketched = store(docs.select("doc_id", F.xxhash64(text).alias("mark"), _sketches(k)(text).alias("s")).select("doc_id", "mark", "s.*"))
    classes = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n", "registers", "bits").agg(F.min("doc_id").alias("rep"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()))
    size = store(sketched.drop("registers", "bits"))
    drop(sketched, shuffles=True)
    members = classes.select("cid", F.explode(_keys("registers")).alias("k"))
    buckets = members.groupBy("k").agg(F.min("cid").alias("c"), F.count("*").alias("size")).where("size > 1")
    buckets = buckets.select(rekey(F.col("k"), "bigint").alias("bucket"), "c")
    shared = store(members.join(buckets, members["k"] == buckets["bucket"]).select("k", "cid", "c"))
    stars = store(shared.where("cid <> c").select("c", "cid").distinct())
    links = _confirmed(stars, classes, docs, k, percent, text)
    joined = components(links)
    # buckets that hold several components: pairs across them
    of = shared.join(joined, shared["cid"] == joined["node"], "left").select("k", "cid", F.coalesce("component", "cid").alias("component"))
    of = store(of)
    drop(shared, shuffles=True)
    several = of.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    several = several.select(rekey(F.col("k"), "bigint").alias("bucket"))
    sizes = classes.select(F.col("cid").alias("id"), "n", _bitmaps("bits").alias("bits"), _keys("registers").alias("keys"))
    rest = store(of.join(several, of["k"] == several["bucket"], "left_semi").join(sizes, of["cid"] == sizes["id"]).drop("id"))
    drop(of)
    one = rest.select(F.col("k").alias("k1"), F.col("cid").alias("c"), F.col("component").alias("m1"), F.col("n").alias("n1"), F.col("bits").alias("bits1"), F.col("keys").alias("keys1"))
    able = F.lit(100) * F.least("n", "n1") >= F.lit(percent) * F.greatest("n", "n1")
    differing = F.expr(" + ".join(f"bit_count(bits[{i}] ^ bits1[{i}])" for i in range(BITS // 64)))
    # similar sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes
    able = able & (F.lit(100 + percent) * differing <= F.lit(100 - percent) * (F.col("n") + F.col("n1")))
    # of the buckets that a pair shares only that of its first band gives the pair
    able = able & (first_shared("keys", "keys1") == F.col("k"))
    pairs = rest.join(one, (F.col("k") == F.col("k1")) & (F.col("m1") < F.col("component")) & able).select("c", "cid").distinct()
    seen = stars.select(F.least("c", "cid").alias("s1"), F.greatest("c", "cid").alias("s2"))
    pairs = store(pairs.join(seen, (F.least("c", "cid") == F.col("s1")) & (F.greatest("c", "cid") == F.col("s2")), "left_anti"))
    drop(rest, stars, shuffles=True)
    more = _confirmed(pairs, classes, docs, k, percent, text)
    if not more.isEmpty():
        first, joined = joined, components(links.unionByName(more))
        drop(first)
    drop(pairs, links, more)
    # the smallest doc_id of each component
    named = classes.select("cid", "rep", "h1", "h2", F.col("n").alias("size")).join(joined, F.col("cid") == F.col("node"), "left")
    named = store(named.withColumn("component", F.coalesce("component", "cid")).drop("node"))
    drop(classes, joined, shuffles=True)
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = least.select(rekey(F.col("component"), "bigint").alias("m"), "component_id")
    named = named.join(least, named["component"] == least["m"]).select("h1", "h2", "size", "component_id")
    ids = size.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    ids = ids.join(named, (ids["g1"] == named["h1"]) & (ids["g2"] == named["h2"]) & (ids["n_shingles"] == named["size"]), "left")
    return ids.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (with doc_id and a text column)."""
    return _judged(docs, k, percent, text).drop("mark")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group; rows without an id stay."""
    gone = _judged(docs, k, percent, text).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_mark"]), "left_anti")
