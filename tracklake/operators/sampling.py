"""Deterministic sampling: everything that draws uses a hash of a seed and an id, so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(seed: int | str, *ids: Column) -> Column:
    """A number in [0, 1) from a seed and ids, by MD5 (so that other engines can repeat it)."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))
    return F.conv(F.substring(text, 1, 12), 16, 10).cast("double") / float(16**12)


def mixture(df: DataFrame, bucket: str, weights: dict[str, float], samples: int, row_id: str, seed: int = 1) -> DataFrame:
    """Rows drawn per bucket by weight; what a bucket lacks is filled from the others' remaining rows in hash order.

    Quotas are floor(samples * weight / all weights). Each bucket's rows are ranked by hash: rank up to the
    quota is taken; then of all left-over rows together the first by hash, up to the shortfall. Ids must differ.
    """
    total = sum(weights.values())
    quota = F.coalesce(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, int(samples * w / total))])[F.col(bucket)], F.lit(0))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    ranked = df.where(F.col(bucket).isin(list(weights))).withColumn("_k", key)
    most = max(int(samples * w / total) for w in weights.values())
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("_k", row_id))
    taken = ranked.withColumn("_r", rank).where(F.col("_r") <= most).where(F.col("_r") <= quota).drop("_r")
    # what is missing is drawn from the rest by a top-k: no task orders all of it
    missing = taken.agg((F.lit(samples) - F.count("*")).alias("_need"))
    rest = ranked.join(taken.select(F.col(row_id).alias("_taken")), F.col(row_id) == F.col("_taken"), "left_anti").orderBy("_k", row_id).limit(samples)
    rest = rest.withColumn("_f", F.row_number().over(Window.orderBy("_k", row_id))).crossJoin(F.broadcast(missing)).where(F.col("_f") <= F.col("_need")).drop("_f", "_need")
    return taken.unionByName(rest).drop("_k")


def shuffled(df: DataFrame, row_id: str, seed: int = 1) -> DataFrame:
    """df in the order of a hash."""
    return df.orderBy(unit(seed, F.col(row_id)), row_id)


def dropout(df: DataFrame, row_id: str, rates: dict[str, float], seed: int = 1) -> DataFrame:
    """A flag drop_<name> per stream, drawn apart for each stream."""
    return df.withColumns({f"drop_{name}": unit(f"{seed}/{name}", F.col(row_id)) < rate for name, rate in rates.items()})


def thin(df: DataFrame, group: Sequence[str], row_id: str, least: int, seed: int = 1) -> DataFrame:
    """Per group, a log-uniform number of rows between ``least`` and all, the first in hash order."""
    w = Window.partitionBy(*group)
    size = F.count("*").over(w)
    goal = F.when(size <= least, size).otherwise(F.floor(F.exp(F.log(F.lit(float(least))) + unit(f"{seed}/n", *[F.col(g) for g in group]) * (F.log(size.cast("double")) - F.log(F.lit(float(least)))))))
    rank = F.row_number().over(w.orderBy(unit(seed, F.col(row_id)), row_id))
    return df.withColumn("_goal", goal).withColumn("_r", rank).where("_r <= _goal").drop("_goal", "_r")


def split(df: DataFrame, row_id: str, share: float = 0.7, seed: int = 1) -> DataFrame:
    """df with ``part``: train or test."""
    return df.withColumn("part", F.when(unit(seed, F.col(row_id)) < share, "train").otherwise("test"))


def hash_holdout(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The n distinct ids that come first by the SHA-1 of the id: a top-k, so partial results merge before the shuffle."""
    return df.select(row_id).distinct().orderBy(F.sha1(F.col(row_id).cast("string")), row_id).limit(n)


def every_kth(df: DataFrame, order: Sequence[str], step: int, n: int, key: Sequence[str] = ()) -> DataFrame:
    """Every step-th row of each group, n at most."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w) - 1).where((F.col("_i") % step == 0) & (F.col("_i") < step * n)).drop("_i")


def round_robin(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """Rows taken in turn from each group: all groups' first rows, then all second ones, n in all."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", rank).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def shards(df: DataFrame, order: Sequence[str], key: Sequence[str], n: int) -> DataFrame:
    """df with ``shard``: the row's place in its group modulo n."""
    return df.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1, F.lit(n)))


def control_rows(df: DataFrame, order: Sequence[str], key: Sequence[str], clip: str, payload: str, pool: int = 32, prime: int = 7919) -> DataFrame:
    """df with ``control``: the payload of another clip, from the pool of the rows before it; null without one."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_pool", F.collect_list(F.struct(F.col(clip).alias("c"), F.col(payload).alias("p"))).over(w.rowsBetween(-pool, -1)))
    others = F.filter("_pool", lambda s: s["c"] != F.col(clip))
    df = df.withColumn("_pool", others)
    place = F.when(F.size("_pool") > 0, F.pmod(F.col("_n").cast("long") * prime, F.greatest(F.size("_pool"), F.lit(1))) + 1).cast("int")
    return df.withColumn("control", F.when(F.size("_pool") > 0, F.try_element_at("_pool", place)["p"])).drop("_n", "_pool")


def rolled(df: DataFrame, batch: Sequence[str], order: Sequence[str], value: str, out: str = "rolled") -> DataFrame:
    """df with the value of the row before it in its batch, the last one's for the first; null in batches of one."""
    w = Window.partitionBy(*batch).orderBy(*order)
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.when(F.count("*").over(Window.partitionBy(*batch)) < 2, None).otherwise(F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(value).over(w))))
