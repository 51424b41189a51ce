"""Statistics: guarded correlation, ridge regression, tests, profiles, optimal assignment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(a: str, b: str, least: int = 5, flat: float | None = 0.0) -> Column:
    """Pearson's r as an aggregate; null under ``least`` pairs, ``flat`` where one side doesn't vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    flat_side = (F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12)
    r = F.try_divide(F.avg(x * y) - F.avg(x) * F.avg(y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) < least, None).when(flat_side, F.lit(flat).cast("double")).otherwise(r)


def contamination(df: DataFrame, by: Sequence[str], answer: str, features: Sequence[str]) -> DataFrame:
    """The largest |r| of an answer with any feature, and what it means."""
    out = df.groupBy(*by).agg(F.greatest(*[F.abs(correlation(answer, f)) for f in features]).alias("max_abs_r"), F.count("*").alias("n"))
    return out.withColumn("verdict", F.when(F.col("max_abs_r") < 0.3, "clean").when(F.col("max_abs_r") < 0.7, "partial").when(F.col("max_abs_r").isNotNull(), "contaminated"))


def per_form_correlation(df: DataFrame, by: Sequence[str], form: str, a: str, b: str, least: int = 5) -> DataFrame:
    """The mean of the forms' correlations, and the pooled one beside it."""
    forms = df.groupBy(*by, form).agg(correlation(a, b, least, None).alias("_r"))
    mean = forms.groupBy(*by).agg(F.avg("_r").alias("mean_r"), F.count("_r").alias("forms"))
    pooled = df.groupBy(*by).agg(correlation(a, b, least, None).alias("pooled_r"))
    return mean.join(pooled, list(by)) if by else mean.crossJoin(pooled)


def contribution(df: DataFrame, by: Sequence[str], mode: str, value: str, full: str = "full", other: str = "shuffled") -> DataFrame:
    """The value in one mode less that in another; null if either is missing."""
    wide = df.groupBy(*by).agg(F.max(F.when(F.col(mode) == full, F.col(value))).alias("a"), F.max(F.when(F.col(mode) == other, F.col(value))).alias("b"))
    return wide.select(*by, (F.col("a") - F.col("b")).alias("contribution"))


def sample_stats(value: str) -> list[Column]:
    """n, mean, sample standard deviation (null under two), min and max."""
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")]


def value_counts(df: DataFrame, by: str) -> DataFrame:
    """Counts and shares of a column's values."""
    out = df.groupBy(by).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return out.crossJoin(total).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def quantile_profile(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.01, 0.5, 0.99), bins: int = 4096) -> DataFrame:
    """One row per column with its exact quantiles, by linear interpolation.

    Equal values are counted first. The counts of bins of equal width tell in which bins the wanted places lie, and
    only these bins' values are put in order: no task holds all distinct values of a column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*")
    counts = long.groupBy("name", "value").agg(F.count("*").alias("k"))
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    totals = counts.groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("k"))), F.lit(0)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    share = F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    # infinite and not-a-number values have bins of their own at the ends
    place = F.when(F.isnan("value"), bins + 1).when(F.col("value") == float("inf"), bins).when(F.col("value") == float("-inf"), -1)
    place = place.otherwise(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (bins - 1)).cast("int"))
    binned = counts.where(F.col("value").isNotNull()).join(F.broadcast(totals), "name").withColumn("bin", place)
    order = Window.partitionBy("name").orderBy("bin")
    tall = binned.groupBy("name", "bin", "n").agg(F.sum("k").alias("size")).withColumn("before", F.sum("size").over(order) - F.col("size"))
    position = {q: F.lit(q) * (F.col("n") - 1) for q in at}
    low, high = {q: F.floor(p) for q, p in position.items()}, {q: F.ceil(p) for q, p in position.items()}
    inside = lambda rank, start, size: (rank >= F.col(start)) & (rank < F.col(start) + F.col(size))
    wanted = F.lit(False)
    for q in at:
        wanted = wanted | inside(low[q], "before", "size") | inside(high[q], "before", "size")
    few = tall.where(wanted).select("name", "bin", "before")
    rows = binned.join(F.broadcast(few), ["name", "bin"])
    rows = rows.withColumn("start", F.col("before") + F.sum("k").over(Window.partitionBy("name", "bin").orderBy("value")) - F.col("k"))
    found = [F.max(F.when(inside(rank[q], "start", "k"), F.col("value"))).alias(f"{side}{i}") for i, q in enumerate(at) for side, rank in (("a", low), ("b", high))]
    ends = totals.select("name", "n").join(rows.groupBy("name").agg(*found), "name", "left")

    def between(i: int, q: float) -> Column:
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        return F.when(a == b, a).otherwise((high[q] - position[q]) * a + (position[q] - low[q]) * b)

    return ends.select("name", "n", *[between(i, q).alias(f"p{round(100 * q)}") for i, q in enumerate(at)])


def coverage_vocabulary(df: DataFrame, token: str, share: float = 0.999) -> DataFrame:
    """The most frequent tokens until their counts reach the share of all; ties in the order of the tokens."""
    counts = df.groupBy(token).agg(F.count("*").alias("n"))
    # the running sum is taken within each count value and across them, so no task orders the whole vocabulary
    levels = counts.groupBy("n").agg(F.count("*").alias("_k"))
    order = Window.orderBy(F.desc("n"))
    levels = levels.withColumn("_before", F.coalesce(F.sum(F.col("n") * F.col("_k")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.withColumn("_all", F.sum(F.col("n") * F.col("_k")).over(Window.partitionBy(F.lit(0)))).drop("_k")
    ranked = counts.join(levels, "n").withColumn("_i", F.row_number().over(Window.partitionBy("n").orderBy(token)) - 1)
    return ranked.where(F.col("_before") + F.col("_i") * F.col("n") < share * F.col("_all")).select(token, "n")


def first_and_last(df: DataFrame, by: Sequence[str], step: str, value: str, larger_is_better: bool = True) -> DataFrame:
    """A metric's first and last value and their relative change, signed so that positive is better."""
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"))
    change = F.try_divide(F.col("last") - F.col("first"), F.abs(F.col("first")))
    return out.withColumn("change", change if larger_is_better else -change)


# ---------------------------------------------------------------- small systems of numbers


def ridge_r2(train: tuple[int, np.ndarray, np.ndarray], test: tuple[int, np.ndarray, np.ndarray], features: Sequence[int], target: int, alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)) -> float:
    """The best held-out R² over a grid of penalties, from each part's size, means and central second moments.

    Features are standardised on the training part, the intercept is free. Everything that the fit and its error
    need are these moments, so a part's rows never have to be in one place.
    """
    (n, mean, cov), (m, test_mean, test_cov) = train, test
    if not n or not m or test_cov[target, target] <= 0:
        return math.nan
    at = np.array(features, int)
    sd = np.sqrt(np.maximum(cov[at, at], 0))
    sd = np.where(sd > 1e-9, sd, 1.0)
    a, b = n * cov[np.ix_(at, at)] / np.outer(sd, sd), n * cov[at, target] / sd
    shift = (test_mean[at] - mean[at]) / sd
    second = test_cov[np.ix_(at, at)] / np.outer(sd, sd) + np.outer(shift, shift)
    off = test_mean[target] - mean[target]
    best = -math.inf
    for alpha in alphas:
        w = np.linalg.solve(a + alpha * np.eye(len(at)), b)
        error = test_cov[target, target] + off**2 - 2 * w @ (test_cov[at, target] / sd + shift * off) + w @ second @ w
        best = max(best, 1 - float(error) / test_cov[target, target])
    return best


def ridge(df: DataFrame, by: Sequence[str], target: str, families: dict[str, Sequence[str]], row_id: str, least: int = 20, unique: bool = False) -> DataFrame:
    """Held-out R² of each family of features, on identical rows and the same split by a hash of the row's id.

    With ``unique`` also, per feature of a family, what R² loses without it. Means and covariances of both parts come
    from one aggregation, combined before the shuffle; the systems are solved on one row per group.
    """
    split = F.pmod(F.xxhash64(row_id), F.lit(10)) < 7
    names = [*sorted({f for fs in families.values() for f in fs}), target]
    size = len(names)
    rows = df.select(*by, split.alias("_train"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(names)]).dropna(subset=[f"_{i}" for i in range(size)])
    aggs = []
    for part, is_train in (("a", True), ("b", False)):
        mine = [F.when(F.col("_train") == is_train, F.col(f"_{i}")) for i in range(size)]
        aggs.append(F.count(mine[0]).alias(f"_n_{part}"))
        aggs.append(F.array(*[F.avg(x) for x in mine]).alias(f"_mean_{part}"))
        aggs.append(F.array(*[F.covar_pop(mine[i], mine[j]) for i in range(size) for j in range(i, size)]).alias(f"_cov_{part}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", family string, without string, n long, r2 double"
    place = {f: i for i, f in enumerate(names)}

    def moments(row: pd.Series, part: str) -> tuple[int, np.ndarray, np.ndarray]:
        n = int(row[f"_n_{part}"])
        if not n:
            return 0, np.zeros(size), np.zeros((size, size))
        cov = np.zeros((size, size))
        cov[np.triu_indices(size)] = row[f"_cov_{part}"]
        return n, np.array(row[f"_mean_{part}"], float), cov + np.triu(cov, 1).T

    def solve(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            out = []
            for _, row in group.iterrows():
                a, b, n = moments(row, "a"), moments(row, "b"), int(row["_n_a"] + row["_n_b"])
                key = [row[k] for k in by]
                for family, features in families.items() if n >= least else ():
                    r2 = ridge_r2(a, b, [place[f] for f in features], place[target])
                    out.append([*key, family, None, n, r2])
                    for f in features if unique and len(features) > 1 else ():
                        out.append([*key, family, f, n, r2 - ridge_r2(a, b, [place[g] for g in features if g != f], place[target])])
            yield pd.DataFrame(out, columns=[*by, "family", "without", "n", "r2"])

    return rows.groupBy(*by).agg(*aggs).mapInPandas(solve, schema)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_p(t: float, freedom: float) -> float:
    """The two-sided p-value of Student's t."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def welch(df: DataFrame, by: Sequence[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t-test and Cohen's d of two groups: moments in one aggregation, then one row per result."""
    part = lambda f, g: f(F.when(F.col(group) == g, F.col(value).cast("double")))
    out = df.groupBy(*by).agg(*[part(f, g).alias(f"{n}_{s}") for s, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    va, vb = F.try_divide(F.col("var_a"), F.col("n_a")), F.try_divide(F.col("var_b"), F.col("n_b"))
    out = out.withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)))
    out = out.withColumn("df", F.try_divide(F.pow(va + vb, F.lit(2.0)), F.try_divide(va * va, F.col("n_a") - 1) + F.try_divide(vb * vb, F.col("n_b") - 1)))
    pooled = F.sqrt(F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("n_a") + F.col("n_b") - 2))
    out = out.withColumn("d", F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled))

    @F.pandas_udf("double")
    def p(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(f) else student_p(x, f) for x, f in zip(t, freedom, strict=True)], dtype="float64")

    return out.withColumn("p", p("t", "df"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairing of rows and columns of the largest total gain (shortest augmenting paths with potentials)."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    row_pot, col_pot, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, end, last = start, -1, -1
        seen = [(start, 0.0)]
        at = 0.0
        while end < 0:
            step = at + cost[row] - row_pot[row] - col_pot
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], last
            column = int(np.argmin(np.where(done, np.inf, reach)))
            at = reach[column]
            done[column] = True
            if owner[column] < 0:
                end = column
            else:
                row, last = int(owner[column]), column
                seen.append((row, at))
        for r, when in seen:
            row_pot[r] += at - when
        col_pot[done] -= at - reach[done]
        while end >= 0:
            back = int(via[end])
            owner[end] = start if back < 0 else owner[back]
            end = back
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return [(c, r) for r, c in pairs] if turned else pairs


def idf1(df: DataFrame, by: Sequence[str], predicted: str, truth: str, n_predicted: DataFrame, n_truth: DataFrame) -> DataFrame:
    """IDF1 of each sequence: co-occurrence counts natively, the assignment of ids on these counts alone.

    df: matched observations (by, predicted id, true id); n_*: (by, n) totals of observations.
    """
    counts = df.groupBy(*by, predicted, truth).agg(F.count("*").alias("n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", idtp long"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index=predicted, columns=truth, values="n", fill_value=0).to_numpy()
        return pd.DataFrame([[*[group[k].iloc[0] for k in by], int(sum(table[i, j] for i, j in assignment(table)))]], columns=[*by, "idtp"])

    hits = counts.groupBy(*by).applyInPandas(one, schema)
    out = n_truth.withColumnRenamed("n", "n_truth").join(n_predicted.withColumnRenamed("n", "n_predicted"), list(by), "full").join(hits, list(by), "left")
    out = out.fillna(0, ["n_truth", "n_predicted", "idtp"])
    return out.withColumn("idf1", F.coalesce(F.try_divide(2.0 * F.col("idtp"), F.col("n_truth") + F.col("n_predicted")), F.lit(0.0)))
