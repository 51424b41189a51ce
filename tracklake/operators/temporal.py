"""Operators on time-ordered rows: nearest and band joins, derivatives, interpolation, windows.

Times are numbers (microseconds or seconds). Every order names a tie-break, so results don't depend on the
order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- neighbours in time


def around(grid: DataFrame, series: DataFrame, key: Sequence[str], t: str, payload: Sequence[str], tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """grid (key, t, ...) with ``before`` and ``after``: structs of the series' last row at or before t and first row at or after it.

    One sort of both sides by key and time, instead of a join. With ``width`` a long series is cut into
    ranges of time: neighbours inside a range are found there, and one row per range carries the last and
    first rows across ranges, so that a key with a large share of all rows spreads over many tasks.
    """
    row = F.struct(F.col(t).alias("t"), *[F.col(c) for c in (*tie, *payload)])
    extra = [c for c in grid.columns if c not in (*key, t)]
    left = grid.select(*key, F.col(t).alias("_t"), F.struct(*(extra or [F.lit(0).alias("_none")])).alias("_g"), F.lit(True).alias("_grid"))
    right = series.select(*key, F.col(t).alias("_t"), F.lit(False).alias("_grid"), row.alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = list(key)
    if width is not None:
        both = both.withColumn("_range", F.floor(F.col("_t") / width))
        part.append("_range")
    # at equal times series rows come first for "before" and last for "after"
    up = Window.partitionBy(*part).orderBy("_t", F.col("_grid").asc(), *[F.col("_row")[c] for c in tie])
    back = up.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part).orderBy(F.col("_t").desc(), F.col("_grid").asc(), *[F.col("_row")[c].desc() for c in tie])
    ahead = down.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.last("_row", ignorenulls=True).over(back)).withColumn("after", F.last("_row", ignorenulls=True).over(ahead))
    if width is not None:
        ranges = both.groupBy(*part).agg(F.max("_row").alias("_last"), F.min("_row").alias("_first"))
        order = Window.partitionBy(*key).orderBy("_range")
        ranges = ranges.withColumn("_prev", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        ranges = ranges.withColumn("_next", F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        both = both.where("_grid").join(ranges.drop("_last", "_first"), part, "left")
        both = both.withColumn("before", F.coalesce("before", "_prev")).withColumn("after", F.coalesce("after", "_next"))
    return both.where("_grid").select(*key, F.col("_t").alias(t), *[F.col("_g")[c].alias(c) for c in extra], "before", "after")


def nearest_join(grid: DataFrame, series: DataFrame, key: Sequence[str], t: str, payload: Sequence[str], tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """grid with ``near``: the series' row nearest in time; of equally near ones the earlier."""
    found = around(grid, series, key, t, payload, tie, width)
    back, ahead = F.col(t) - F.col("before.t"), F.col("after.t") - F.col(t)
    near = F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.coalesce("after", "before"))
    return found.withColumn("near", near).drop("before", "after")


def interpolate(grid: DataFrame, series: DataFrame, key: Sequence[str], t: str, values: Sequence[str], tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """grid with the values linearly interpolated at t, constant beyond the ends."""
    found = around(grid, series, key, t, values, tie, width)
    share = F.try_divide(F.col(t) - F.col("before.t"), F.col("after.t") - F.col("before.t"))
    for v in values:
        a, b = F.col("before")[v], F.col("after")[v]
        inside = F.when(F.col("after.t") == F.col("before.t"), a).otherwise(a + (b - a) * share)
        found = found.withColumn(v, F.when(F.col("before").isNull(), b).when(F.col("after").isNull(), a).otherwise(inside))
    return found.drop("before", "after")


def wrap(angle: Column, turn: float) -> Column:
    """The angle's difference from 0 in [-turn/2, turn/2)."""
    return F.pmod(angle + F.lit(turn / 2), F.lit(turn)) - F.lit(turn / 2)


def band_join(left: DataFrame, right: DataFrame, key: Sequence[str], t: str, within: float, right_t: str | None = None) -> DataFrame:
    """Pairs with equal keys and |right_t - t| <= within; the right side's other names must differ.

    Both sides fall into buckets of the band's width; a left row looks into three of them, so this is an
    equi-join with an exact condition, and never a nested loop.
    """
    right_t = right_t or f"{t}_r"
    left = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(t) / within) + d for d in (-1, 0, 1)])))
    right = right.withColumn("_bucket", F.floor(F.col(right_t) / within))
    return left.join(right, [*key, "_bucket"]).where(F.abs(F.col(right_t) - F.col(t)) <= within).drop("_bucket")


def nearest_per_track(pairs: DataFrame, anchor: Sequence[str], track: str, t: str, right_t: str) -> DataFrame:
    """Of each anchor's rows of one track the one nearest in time (then the earlier)."""
    best = Window.partitionBy(*anchor, track).orderBy(F.abs(F.col(right_t) - F.col(t)), right_t)
    return pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def horizons(anchors: DataFrame, series: DataFrame, key: Sequence[str], t: str, steps: Sequence[float], within: float, payload: Sequence[str], tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """anchors at t + step for each step, with the nearest row no further than ``within``; stops at the first miss."""
    grid = anchors.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).withColumnRenamed(t, "_anchor").withColumn(t, F.col("_anchor") + F.col("step"))
    found = nearest_join(grid, series, key, t, payload, tie, width)
    found = found.withColumn("_miss", F.col("near").isNull() | (F.abs(F.col("near.t") - F.col(t)) > within))
    first = F.min(F.when(F.col("_miss"), F.col("step"))).over(Window.partitionBy(*key, "_anchor"))
    found = found.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("step") < F.col("_first")))
    return found.drop(t, "_miss", "_first").withColumnRenamed("_anchor", t)


def as_of_forward(grid: DataFrame, series: DataFrame, key: Sequence[str], t: str, payload: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """grid with ``next``: the series' first row at or after t."""
    return around(grid, series, key, t, payload, tie).withColumnRenamed("after", "next").drop("before")


# ---------------------------------------------------------------- derivatives and running values


def gradient(y: str, t: str, key: Sequence[str], order: Sequence[str]) -> Column:
    """dy/dt by central differences over uneven times, one-sided at the ends; null for a single row."""
    w = Window.partitionBy(*key).orderBy(*order)
    y0, y1, y2 = F.lag(y).over(w), F.col(y), F.lead(y).over(w)
    hs, hd = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    inner = F.try_divide(hs * hs * y2 + (hd * hd - hs * hs) * y1 - hd * hd * y0, hs * hd * (hs + hd))
    return F.when(y0.isNull() & y2.isNull(), None).when(y0.isNull(), F.try_divide(y2 - y1, hd)).when(y2.isNull(), F.try_divide(y1 - y0, hs)).otherwise(inner)


def index_gradient(y: str, t: str, key: Sequence[str], order: Sequence[str]) -> Column:
    """The difference of the neighbours' values over that of their times: the other gradient, which ignores spacing."""
    w = Window.partitionBy(*key).orderBy(*order)
    a, b = F.coalesce(F.lag(y).over(w), F.col(y)), F.coalesce(F.lead(y).over(w), F.col(y))
    s, e = F.coalesce(F.lag(t).over(w), F.col(t)), F.coalesce(F.lead(t).over(w), F.col(t))
    return F.try_divide(b - a, e - s)


def unwrap(df: DataFrame, y: str, key: Sequence[str], order: Sequence[str], turn: float, out: str, keep_half: bool = True) -> DataFrame:
    """df with jumps of more than half a turn taken out of an angle.

    A jump up by exactly half a turn stays, as in numpy; without ``keep_half`` it is taken out as well, and the
    turns in a jump are counted by the floor of their quotient.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    d = F.col(y) - F.lag(y).over(w)
    if keep_half:
        wrapped = wrap(d, turn)
        wrapped = F.when((wrapped == -turn / 2) & (d > 0), F.lit(turn / 2)).otherwise(wrapped)
    else:
        wrapped = d + turn / 2 - turn * F.floor((d + turn / 2) / turn) - turn / 2
    df = df.withColumn("_fix", F.when(F.abs(d) < turn / 2, F.lit(0.0)).otherwise(F.coalesce(wrapped - d, F.lit(0.0))))
    return df.withColumn(out, F.col(y) + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")


def step_length(values: Sequence[str], key: Sequence[str], order: Sequence[str]) -> Column:
    """The Euclidean distance from the row before; 0 for the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    return F.coalesce(F.sqrt(sum((F.pow(F.col(v) - F.lag(v).over(w), F.lit(2.0)) for v in values), F.lit(0.0))), F.lit(0.0))


def travelled(df: DataFrame, values: Sequence[str], key: Sequence[str], order: Sequence[str], out: str = "travelled") -> DataFrame:
    """df with the distance covered so far."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_step", step_length(values, key, order)).withColumn(out, F.sum("_step").over(w)).drop("_step")


def track_speeds(df: DataFrame, values: Sequence[str], t: str, key: Sequence[str], order: Sequence[str], least: int = 3) -> DataFrame:
    """Rows of tracks with at least ``least`` observations, with v_<value> by central differences and speed."""
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where(F.col("_n") >= least).drop("_n")
    for v in values:
        df = df.withColumn(f"v_{v}", gradient(v, t, key, order))
    return df.withColumn("speed", F.sqrt(sum((F.pow(F.col(f"v_{v}"), F.lit(2.0)) for v in values), F.lit(0.0))))


def local_ids(df: DataFrame, scene: Sequence[str], track: str, t: str, out: str = "local_id") -> DataFrame:
    """df with each scene's tracks numbered from 1 by first appearance (then by track)."""
    df = df.withColumn("_first", F.min(t).over(Window.partitionBy(*scene, track)))
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*scene).orderBy("_first", track))).drop("_first")


# ---------------------------------------------------------------- windows and grids


def windows(df: DataFrame, start: str, end: str, history: int, future: int, stride: int, out: str = "t0") -> DataFrame:
    """One row for each t0 from start + history by stride, as long as t0 + future doesn't pass the end."""
    last = F.col(end) - future
    at = F.when(last >= F.col(start) + history, F.sequence(F.col(start) + history, last, F.lit(stride)))
    return df.withColumn(out, F.explode(at))


def with_context(df: DataFrame, key: Sequence[str], order: Sequence[str], before: int, after: int) -> DataFrame:
    """Rows with at least so many rows before and after them in their group; adds idx and size."""
    w = Window.partitionBy(*key)
    df = df.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("size", F.max("idx").over(w) + 1)
    return df.where((F.col("idx") >= before) & (F.col("size") - 1 - F.col("idx") >= after))


def last_scans(df: DataFrame, key: Sequence[str], order: Sequence[str], frames: int) -> DataFrame:
    """The last ``frames`` rows of each group in slots 0 to frames-1; missing slots at the front repeat the first row."""
    w = Window.partitionBy(*key)
    df = df.withColumn("_r", F.row_number().over(w.orderBy(*[F.col(o).desc() for o in order]))).where(F.col("_r") <= frames)
    df = df.withColumn("_size", F.max("_r").over(w))
    slots = F.when(F.col("_r") == F.col("_size"), F.sequence(F.lit(0), F.lit(frames) - F.col("_size"))).otherwise(F.array(F.lit(frames) - F.col("_r")))
    return df.withColumn("slot", F.explode(slots)).drop("_r", "_size")


def fixed_rate(ends: DataFrame, t: str, frames: int, step: float) -> DataFrame:
    """A grid of ``frames`` times that ends at t, ``step`` apart; slot 0 is the earliest."""
    slots = ends.withColumnRenamed(t, "_end").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return slots.withColumn(t, F.col("_end") - (F.lit(frames - 1) - F.col("slot")) * step).drop("_end")


def subsample_back(df: DataFrame, key: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every step-th row counted from the last; offset is 0 for the last row and negative before."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])) - 1
    return df.withColumn("_b", back).where(F.col("_b") % step == 0).withColumn("offset", -F.col("_b")).drop("_b")


def history_block(df: DataFrame, key: Sequence[str], order: Sequence[str], text: str, size: int, out: str = "history", empty: str = "t-1s: none") -> DataFrame:
    """df with the texts of up to ``size`` rows before it, oldest first, as lines ``t-<age>s: <text>``."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-size, -1)
    df = df.withColumn("_seen", F.collect_list(F.coalesce(F.col(text), F.lit("none"))).over(w))
    lines = F.transform("_seen", lambda x, i: F.concat(F.lit("t-"), (F.size("_seen") - i).cast("string"), F.lit("s: "), x))
    return df.withColumn(out, F.when(F.size("_seen") == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n"))).drop("_seen")
