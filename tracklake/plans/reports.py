"""Report tables over logged metrics and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import round_even
from ..operators import scoring as SC
from ..operators import stats as ST


def teacher_forced(rows: DataFrame) -> DataFrame:
    """Per mode and task: mean loss, perplexity, digit loss and accuracy; rows hold sums and counts."""
    per = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    out = rows.groupBy("mode", "task").agg(per("loss_sum", "tokens").alias("loss"), per("digit_loss_sum", "digits").alias("digit_loss"), per("digit_hits", "digits").alias("digit_accuracy"))
    return out.withColumn("perplexity", F.exp("loss"))


def mode_deltas(table: DataFrame, value: str, base: str = "full") -> DataFrame:
    """Each other mode's value less the base mode's, per task."""
    b = table.where(F.col("mode") == base).select("task", F.col(value).alias("_b"))
    return table.where(F.col("mode") != base).join(b, "task").select("task", "mode", (F.col(value) - F.col("_b")).alias("delta"))


def micro_macro(batches: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all valid points, and the mean of the batches' errors."""
    return batches.groupBy(*by).agg(F.try_divide(F.sum("hits"), F.sum("valid")).alias("micro_accuracy"), F.avg("mae").alias("macro_mae"))


def rescored(generations: DataFrame) -> DataFrame:
    """Generations with their family and reward; only those with the model's full input."""
    full = generations.where("mode = 'full'").withColumn("family", SC.family(F.col("task")))
    return full.withColumn("reward", SC.reward(F.col("task"), F.col("generated"), F.col("reference"))).groupBy("task", "family").agg(F.count("*").alias("n"), F.avg("reward").alias("reward"))


def first_metric(table: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's first metric that is there, with its name."""
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return table.withColumn("metric", name).withColumn("value", F.coalesce(*columns))


def numeric_report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean error and correlation of predictions beside those of the constant median."""
    ok = pairs.where(F.col("pred").isNotNull() & F.col("truth").isNotNull() & ~F.isnan("pred") & ~F.isnan("truth"))
    median = ok.groupBy(*by).agg(F.median("truth").alias("_m"))
    return ok.join(median, by).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae"), F.avg(F.abs(F.col("_m") - F.col("truth"))).alias("baseline_mae"), ST.correlation("pred", "truth").alias("corr"))


def loss_gaps(runs: DataFrame, radar: list[str], camera: list[str]) -> DataFrame:
    """Per run: the mean gap on radar tasks, on camera tasks, and their ratio where the latter isn't nothing."""
    mean = lambda tasks: F.avg(F.when(F.col("task").isin(tasks), F.col("delta")))
    out = runs.groupBy("run").agg(mean(radar).alias("radar_gap"), mean(camera).alias("camera_gap"))
    return out.withColumn("selectivity", F.when(F.col("camera_gap") > 1e-4, F.try_divide(F.col("radar_gap"), F.col("camera_gap")))).orderBy(F.desc_nulls_last("selectivity"), "run")


def mean_contribution(corr: DataFrame, by: list[str]) -> DataFrame:
    """The mean over tasks of full less shuffled; tasks without both count for nothing."""
    return ST.contribution(corr, [*by, "task"], "mode", "corr").groupBy(*by).agg(F.avg("contribution").alias("score"))


def select_seed(val: DataFrame, test: DataFrame, metric: str) -> DataFrame:
    """The seed that is best on validation, reported on test alone."""
    best = val.orderBy(F.desc_nulls_last(metric), "seed").limit(1).select("seed")
    return test.join(best, "seed", "left_semi")


def keep_best(checkpoints: DataFrame, metric: str, k: int) -> DataFrame:
    return checkpoints.orderBy(F.desc_nulls_last(metric), "step").limit(k)


def trend(log: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """First and last value of each metric; true where larger is better."""
    out = None
    for m, up in metrics.items():
        row = ST.first_and_last(log, [], "step", m, up).withColumn("metric", F.lit(m))
        out = row if out is None else out.unionByName(row)
    ranked = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("change"), "metric")))
    return ranked.select("metric", "first", "last", "change", "rank")


def trend_row(generations: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """One row of metrics with a prefix per domain."""
    long = generations.groupBy("domain").agg(F.avg("err").alias("ade"), F.avg("chamfer").alias("chamfer"))
    return long.groupBy().agg(*[F.max(F.when(F.col("domain") == d, F.col(m))).alias(f"{p}{m}") for d, p in prefixes.items() for m in ("ade", "chamfer")])


def memory_plan(modes: DataFrame, layers: int, width: int, tokens: int, limit_gib: float) -> DataFrame:
    """Combinations (mode, shards, checkpointing) with their memory; the preferred first of those that fit."""
    act = F.lit(layers * width * tokens * 2 / 2**30) * F.when(F.col("checkpointing"), 0.1).otherwise(1.0)
    out = modes.withColumn("gib", act + F.col("weights_gib") / F.col("shards")).where(F.col("gib") <= limit_gib)
    return out.orderBy(F.col("checkpointing"), "shards", "gib")


def horizon_errors(generations: DataFrame, by: list[str], steps: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mean distance of generated from true waypoints at each step that both texts have; null where none does."""
    both = generations.select(*by, X.waypoints(F.col("generated")).alias("p"), X.waypoints(F.col("reference")).alias("q"))
    apart = lambda h: F.hypot(F.try_element_at("p", F.lit(h))[0] - F.try_element_at("q", F.lit(h))[0], F.try_element_at("p", F.lit(h))[1] - F.try_element_at("q", F.lit(h))[1])
    return both.groupBy(*by).agg(*[F.avg(apart(h)).alias(f"l2_{h}s") for h in steps])


def detection_distances(generations: DataFrame, by: list[str], near: float = 2.0) -> DataFrame:
    """Over all true objects of answers that list any: the median distance to the nearest listed one, and the share within ``near``."""
    both = generations.select(*by, X.objects(F.col("generated")).alias("p"), X.objects(F.col("reference")).alias("t")).where((F.size("p") > 0) & (F.size("t") > 0))
    rows = both.select(*by, F.explode(SC.chamfer(F.col("p"), F.col("t"))).alias("d"))
    return rows.groupBy(*by).agg(F.median("d").alias("chamfer"), F.avg((F.col("d") <= near).cast("int")).alias("within"))


def contains_share(items: DataFrame, by: list[str], text: str, phrases: dict[str, str]) -> DataFrame:
    """The share of texts that contain each phrase."""
    return items.groupBy(*by).agg(*[F.avg(F.col(text).contains(p).cast("int")).alias(name) for name, p in phrases.items()])


def frame_guard(frames: DataFrame, by: list[str], data: str) -> DataFrame:
    """How many frames there are and how many differ; ``broken`` where several frames are all the same."""
    out = frames.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(F.md5(data)).alias("n_distinct"))
    return out.withColumn("broken", (F.col("n") > 1) & (F.col("n_distinct") == 1))


def pooled_idf1(sequences: DataFrame, by: list[str]) -> DataFrame:
    """IDF1 of the summed counts beside the mean of the sequences' own; sequences: idtp, n_predicted, n_truth, idf1."""
    out = sequences.groupBy(*by).agg(F.count("*").alias("n"), F.sum("idtp").alias("tp"), F.sum(F.col("n_predicted") + F.col("n_truth")).alias("all"), F.avg("idf1").alias("per_sequence"))
    return out.select(*by, "n", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("all")), F.lit(0.0)).alias("pooled"), "per_sequence")


def token_confidences(tokens: DataFrame, by: list[str], place: str, piece: str, probability: str) -> DataFrame:
    """The mean probability of the tokens of each part of an answer; a part ends with the token that holds a semicolon."""
    earlier = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.count_if(F.col(piece).contains(";")).over(earlier), F.lit(0))
    return tokens.withColumn("part", part).groupBy(*by, "part").agg(round_even(F.avg(probability), 4).alias("confidence"))


def padded(points: DataFrame, by: list[str], order: list[str], values: list[str], size: int) -> DataFrame:
    """One row per group: ``size`` rows of values, padded by zeros, and a mask of the real ones."""
    ranked = points.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("_i") < size)
    out = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", F.array(*values).alias("v")))).alias("_p"))
    slot = lambda f, empty: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i < F.size("_p"), f(i)).otherwise(empty))
    zeros = F.array(*[F.lit(0.0) for _ in values])
    return out.withColumn("points", slot(lambda i: F.get("_p", i)["v"], zeros)).withColumn("mask", slot(lambda i: F.lit(True), F.lit(False))).drop("_p")


def sparse(rows: DataFrame, by: list[str]) -> DataFrame:
    """The real rows of padded ones, with their slot."""
    return rows.select(*by, F.posexplode(F.arrays_zip("points", "mask")).alias("slot", "e")).where("e.mask").select(*by, "slot", F.col("e.points").alias("point"))
