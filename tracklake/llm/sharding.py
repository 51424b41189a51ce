"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows fall into source blocks by a hash of their values; a count gives each block's size. Rows of a value that
   more of them share than a block should hold are told apart by a number first, so they spread like others.
2. The matrix of how many rows each block sends to each shard is drawn row by row from the multivariate
   hypergeometric distribution of the places that are left. Its margins are exact: block sizes on one side, shard
   sizes (at most one apart) on the other. The driver draws it for groups of a thousand blocks, and each group's
   row is then drawn apart into its blocks' rows, by the same law, where the group is.
3. Each block is permuted locally by a seeded key, and the matrix row cuts it into shards.
4. After the exchange each shard is permuted again: a second key gives the slot. A shard is cut into key
   ranges, whose counts give each range's first slot, so no task holds a whole shard.

The matrix has (blocks x shards) integers; blocks grow with the rows, ``rows_per_block`` each, and the driver holds
a thousandth of them. Under the law ``rows`` equal texts needn't stay together. Defined results: null texts have 8 bytes and the CRC of no
bytes; rows that are equal in every used value are interchangeable; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop, store

#: Blocks whose rows of the matrix are drawn together.
GROUP = 1000


def matrix(blocks: dict[int, int], shards: int, seed: int | tuple[int, ...], places: list[int] | None = None) -> dict[int, list[int]]:
    """For each block the number of its rows that go to each shard; places: the shards' sizes, else as equal as can be."""
    total = sum(blocks.values())
    left = np.array([total // shards + (s < total % shards) for s in range(shards)] if places is None else places, np.int64)
    rng, out = np.random.default_rng(seed), {}
    for b in sorted(blocks):
        draw = np.zeros(shards, np.int64)
        rest, places = blocks[b], int(left.sum())
        for s in range(shards):  # conditional hypergeometric draws
            places -= int(left[s])
            draw[s] = rest if places == 0 else _hypergeometric(rng, int(left[s]), places, rest)
            rest -= int(draw[s])
        left -= draw
        out[b] = draw.tolist()
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy's draw; beyond its range, by inversion."""
    if n == 0 or good == 0:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    return _inverted(rng, good, bad, n)


def _inverted(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw by inversion, for any size.

    The odds of neighbouring values are exact ratios, which multiply up from the least value. Values more than ten
    deviations and 40 from the mode weigh less than 1e-21 together (Bernstein), under the step of a 53-bit uniform.
    """
    total = good + bad
    p = good / total
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = math.ceil(10 * math.sqrt(n * p * (1 - p) * (total - n) / max(total - 1, 1))) + 40
    lo, hi = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1)))))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return lo + min(int(np.searchsorted(weights, rng.random() * weights[-1], side="right")), hi - lo)


def _told_apart(rows: DataFrame, full: DataFrame, limit: int) -> DataFrame:
    """rows, in which those of a value in a full block that more than ``limit`` share have hashes of their own.

    They are numbered: within each partition, and on from what the partitions before hold. Which row has which
    number depends on the partitions; that each number is there doesn't.
    """
    heavy = rows.join(full.select("_block"), "_block", "left_semi").groupBy("_first", "_second").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    heavy = store(heavy.select(F.col("_first").alias("_f"), F.col("_second").alias("_s")))
    if heavy.isEmpty():
        drop(heavy)
        return rows
    marked = rows.withColumn("_part", F.spark_partition_id()).join(heavy, (F.col("_first") == F.col("_f")) & (F.col("_second") == F.col("_s")), "left").drop("_s")
    marked = cut(marked)
    same = marked.where("_f IS NOT NULL")
    held = same.groupBy("_first", "_second", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_first", "_second").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("_first").alias("_a"), F.col("_second").alias("_b"), F.col("_part").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_first", "_second", "_part").orderBy(F.lit(0))) + F.col("_before")
    same = same.join(held, (F.col("_first") == F.col("_a")) & (F.col("_second") == F.col("_b")) & (F.col("_part") == F.col("_c"))).withColumn("_i", number)
    same = same.withColumn("_first", F.xxhash64("_first", "_i")).withColumn("_second", F.xxhash64("_second", "_i"))
    return cut(marked.where("_f IS NULL").drop("_f", "_part").unionByName(same.select(*rows.columns)))


def shard_rows(rows: DataFrame, shards: int, key: list[Column], seed: int = 7, rows_per_block: int = 50_000, rows_per_range: int = 50_000) -> DataFrame:
    """rows with ``shard`` and ``slot``; key: what identifies a row, hashed for all random orders."""
    first, second = F.xxhash64(F.lit(seed), *key), F.xxhash64(F.lit(seed + 1), *key)
    rows = cut(rows.withColumn("_first", first).withColumn("_second", second))
    total = rows.count()
    n_blocks = max(1, math.ceil(total / rows_per_block))
    block = F.pmod(F.xxhash64(F.lit(seed + 2), "_first", "_second"), F.lit(n_blocks))
    count = lambda df: store(df.groupBy("_block").agg(F.count("*").alias("_n")))
    blocks = count(rows.withColumn("_block", block))
    even = _told_apart(rows.withColumn("_block", block), blocks.where(F.col("_n") > 2 * rows_per_block), rows_per_block).drop("_block").withColumn("_block", block)
    if not blocks.where(F.col("_n") > 2 * rows_per_block).isEmpty():
        drop(blocks)
        blocks = count(even)
    rows, n_groups = even, math.ceil(n_blocks / GROUP)
    groups = blocks.groupBy(F.pmod("_block", F.lit(n_groups)).alias("_group")).agg(F.sum("_n").alias("_n"))
    counts = {r["_group"]: r["_n"] for r in groups.collect()}
    spark = rows.sparkSession
    top = spark.createDataFrame(list(matrix(counts, shards, seed).items()), "_of long, _places array<bigint>")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        found = matrix(dict(zip(group["_block"].tolist(), group["_n"].tolist(), strict=True)), shards, (seed, int(group["_of"].iloc[0])), list(group["_places"].iloc[0]))
        return pd.DataFrame([(b, np.cumsum(v).tolist()) for b, v in found.items()], columns=["_block", "_ends"])

    parts = blocks.join(top, F.pmod("_block", F.lit(n_groups)) == F.col("_of"))
    table = store(parts.groupBy("_of").applyInPandas(draw, "_block long, _ends array<bigint>"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_first", "_second")) - 1
    rows = rows.withColumn("_rank", rank).join(table, "_block")
    # the shard is the number of cumulative counts that the rank has reached
    rows = rows.withColumn("shard", F.expr("cast(size(filter(_ends, e -> e <= _rank)) as int)"))
    n_ranges = max(1, math.ceil(total / shards / rows_per_range))
    width = math.ceil(2**63 / n_ranges)
    rows = rows.withColumn("_range", F.expr(f"cast(shiftrightunsigned(_second, 1) div {width}L as int)") if n_ranges > 1 else F.lit(0))
    rows = cut(rows.drop("_block", "_rank", "_ends"))
    sizes = rows.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_second", "_first")) - 1
    rows = rows.withColumn("_place", place).join(sizes, ["shard", "_range"])
    return rows.withColumn("slot", (F.col("_before") + F.col("_place")).cast("long")).drop("_first", "_second", "_range", "_place", "_before")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7, rows_per_block: int = 50_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    out = shard_rows(rows, shards, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], seed, rows_per_block)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
