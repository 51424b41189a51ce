"""Exact top-k by inner product over vectors in order of descending length.

Vectors are integers, floor(scale * x). Of equal vectors only the k + 1 smallest ids can be in a result, so
a vector that a large share of the rows repeats shrinks to that before anything else happens.

1. An orthogonal rotation from the singular vectors of a bounded sample moves most of the length into the
   first coordinates. It only serves the bounds; scores are computed from the integers.
2. The ``head`` longest vectors give every query a first k-th score.
3. Candidates are cut into bands by descending length, and bands into blocks of bounded size; queries into
   blocks too, in the order of the length that a vector must have to reach their k-th score (Cauchy-Schwarz). A
   query goes only to bands that have such vectors, a band only to blocks that have such queries.
4. A block of queries meets a block of candidates in pieces of descending length: the sum over the first
   rotated coordinates plus the product of the remaining lengths bounds each score; only pairs whose bound
   reaches the k-th score so far are scored exactly, and the k-th scores rise.
5. The best k of each block are merged by query.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take
no part; a row repeated with the same id counts once; an id with several vectors is a candidate with each of
them and as a query has the best of all; shorter vectors count as padded by zeros; fewer candidates than k give
fewer rows; an empty table gives none; other columns play no part. Vectors so long that a score could exceed 64
bits raise an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BANDS, SAMPLE_ROWS, FIRST = 64, 2048, 16


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a list column, padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q and x."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Best:
    """The best k (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        query, score, ident = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        first = np.searchsorted(query, query)
        rank = np.arange(query.size) - first
        keep = rank < self.k
        self.query, self.score, self.id = query[keep], score[keep], ident[keep]
        last = rank[keep] == self.k - 1
        self.least[self.query[last]] = np.maximum(self.least[self.query[last]], self.score[last])


def search(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, x_ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, piece: int = 1024) -> Best:
    """The best k of the candidates x for each query that can reach the query's least score."""
    best = Best(len(q), k, least.astype(np.float64).copy())
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    x_ids, x, length = x_ids[order], x[order], length[order]
    turned_q, turned_x = q @ rotation, x @ rotation
    rest_q, rest_x = (np.sqrt((t[:, FIRST:] ** 2).sum(axis=1)) for t in (turned_q, turned_x))
    length_q = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    for lo in range(0, len(x), piece):
        hi = min(lo + piece, len(x))
        slack = 1e-6 + 1e-9 * length_q * length[lo]
        able = np.flatnonzero(length_q * length[lo] + slack >= best.least)
        if not able.size:
            break  # all that follow are shorter
        bound = turned_q[able, :FIRST] @ turned_x[lo:hi, :FIRST].T + rest_q[able][:, None] * rest_x[lo:hi][None, :]
        near = bound + slack[able][:, None] >= best.least[able][:, None]
        rows, columns = np.nonzero(near)
        if rows.size * 4 > near.size:
            score = products(q[able], x[lo:hi])[rows, columns]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[able[rows[i : i + 65536]]], x[lo + columns[i : i + 65536]]) for i in range(0, rows.size, 65536)] or [np.empty(0, np.int64)])
        query, ident = able[rows], x_ids[lo + columns]
        keep = (score >= best.least[query]) & (ident != q_ids[query])
        best.add(query[keep], score[keep], ident[keep])
    return best


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, block: int = 8192, head: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's best k. Queries: rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    all_rows = cut(rows.withColumn("length", length))
    some = cut(all_rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"))
    asked = all_rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    schema = "query_id long, vec_id long, score long"
    stats = some.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("length").alias("longest"), F.percentile_approx("length", [i / BANDS for i in range(1, BANDS)], 10_000).alias("edges")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if stats["longest"] ** 2 >= 2.0**63:
        raise OverflowError("inner products of these vectors can exceed 64 bits")
    width = max(1, stats["width"])
    sample = some.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v").toArrow().column("v")
    rotation = np.linalg.svd(_matrix(sample, width).astype(np.float64), full_matrices=True)[2].T
    longest = some.orderBy(F.desc("length"), "vec_id").limit(min(head, block)).select("vec_id", "v").toArrow()
    shared = spark.sparkContext.broadcast((rotation, longest.column("vec_id").to_numpy(), _matrix(longest.column("v"), width)))

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, x = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                q_ids, q = part.column(0).to_numpy(), _matrix(part.column(1), width)
                best = search(q_ids, q, np.full(len(q), -np.inf), ids, x, turn, k)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.least)], ["query_id", "q", "q_length", "least"])

    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("length").alias("q_length"))
    asked = cut(asked.mapInArrow(first_scores, "query_id long, q array<long>, q_length double, least double"))
    edges = sorted({float(e) for e in stats["edges"]}, reverse=True)  # band 0 is the longest
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e > F.col("length"))) if edges else F.lit(0)
    banded = some.withColumn("band", band)
    found = banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()
    blocks = {r["band"]: math.ceil(r["n"] / block) for r in found}
    parts = F.create_map(*[F.lit(x) for r in blocks.items() for x in r])
    where = F.array(*[F.struct(F.lit(r["band"]).alias("band"), F.lit(float(r["top"])).alias("top"), F.lit(blocks[r["band"]]).alias("parts")) for r in found])
    # the length from which on a vector can reach the k-th score; groups of queries by it, cut into blocks
    asked = asked.withColumn("need", F.when(F.col("q_length") > 0, (F.col("least") - 1e-6) / (F.col("q_length") * (1 + 1e-9)) * (1 - 1e-9)).otherwise(F.lit(float("-inf"))))
    n_groups = min(BANDS, math.ceil(asked.count() / (block // 2)))
    cuts = asked.agg(F.percentile_approx("need", [i / n_groups for i in range(1, n_groups)], 10_000).alias("cuts")).first()["cuts"] if n_groups > 1 else []
    group = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>"), lambda c: c < F.col("need")))
    asked = asked.withColumn("group", group)
    sizes = sorted(map(tuple, asked.groupBy("group").agg(F.count("*"), F.min("need")).collect()))
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    counts = [math.ceil(n / (block // 2)) for _, n, _ in sizes]
    before = F.create_map(*[F.lit(x) for (g, *_), b in zip(sizes, itertools.accumulate(counts, initial=0), strict=False) for x in (g, b)])
    many = F.create_map(*[F.lit(x) for (g, *_), c in zip(sizes, counts, strict=True) for x in (g, c)])
    q_block = (before[F.col("group")] + F.pmod(F.xxhash64("query_id"), many[F.col("group")])).cast("int")
    reach = F.filter(where, lambda b: b["top"] >= F.col("need"))
    sent = asked.withColumn("q_block", q_block).withColumn("b", F.explode(reach)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("b")["parts"] - 1)))
    sent = sent.select("q_block", F.col("b")["band"].alias("band"), "part", "query_id", "q", "least")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), parts[F.col("band")]).cast("int")
    # of each band how many blocks have queries that it can matter to: the first ones
    asking = F.create_map(*[F.lit(x) for r in found for x in (r["band"], sum(c for (_, _, need), c in zip(sizes, counts, strict=True) if need <= r["top"]))])
    offered = banded.withColumn("part", part).withColumn("asking", asking[F.col("band")]).where("asking > 0")
    offered = offered.select(F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("q_block"), "band", "part", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        if not len(q_ids) or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        best = search(q_ids, _matrix(left.column("q"), width), left.column("least").to_numpy(), ids, _matrix(right.column("v"), width), shared.value[0], k)
        return pa.table({"query_id": q_ids[best.query], "vec_id": best.id, "score": best.score})

    keys = ["q_block", "band", "part"]
    met = sent.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
