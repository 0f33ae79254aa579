"""Rank tests, effect sizes, correlations and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlbrook.operators.order import ranked_values
from marlbrook.shared import cut


def rank_sums(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """One row: n_a, n_b, rank_sum_a (average ranks), u_a, tie_term. Ranks come from counts of distinct values; no row is ranked by itself."""
    r = ranked_values(df.where(in_a | in_b), value, {"a": in_a})
    mean_rank = F.col("before") + (F.col("n") + 1) / 2
    s = r.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.col("n") - F.col("n_a")), F.lit(0)).alias("n_b"), F.coalesce(F.sum(F.col("n_a") * mean_rank), F.lit(0.0)).alias("rank_sum_a"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")), F.lit(0.0)).alias("tie_term"))
    return s.select("n_a", "n_b", "rank_sum_a", (F.col("rank_sum_a") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u_a"), "tie_term")


#: Largest n * m whose exact law is written out (8 bytes a value); larger ones take the law of a sum of uniform variates, which it has become by then.
LAW_SIZE = 20_000_000


def _exact_p(u: float, n: int, m: int) -> float:
    """Two-sided p of U without ties for a small group of n. The number of ways to each value is a Gaussian binomial coefficient, built factor by factor."""
    n, m = min(n, m), max(n, m)
    low = min(u, n * m - u)
    if n * m > LAW_SIZE:
        x = low / m
        return min(1.0, 2 * sum((-1) ** k * math.comb(n, k) * (x - k) ** n for k in range(math.floor(x) + 1)) / math.factorial(n))
    law = np.zeros(n * m + 1)
    law[0] = 1.0
    for i in range(1, n + 1):  # times (1 - q^(m+i)) / (1 - q^i)
        above = law[: max(0, len(law) - m - i)].copy()
        law[m + i :] -= above
        pad = np.append(law, np.zeros(-len(law) % i)).reshape(-1, i)
        law = np.cumsum(pad, 0).ravel()[: n * m + 1]
    return float(min(1.0, 2 * law[: math.floor(low) + 1].sum() / math.comb(n + m, n)))


def mann_whitney_p(n: int, m: int, u: float, ties: float) -> float:
    """Two-sided p of Mann-Whitney's U: exact for a small group without ties, else normal with corrections for ties and continuity."""
    if not n or not m:
        return math.nan
    if min(n, m) <= 8 and not ties:
        return _exact_p(u, n, m)
    t = n + m
    sd = math.sqrt(n * m / 12 * ((t + 1) - ties / (t * (t - 1))))
    if not sd:
        return 1.0
    return min(1.0, math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / sd / math.sqrt(2)))


def magnitude(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def cliffs_delta(df: DataFrame, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """n_a, n_b, delta, magnitude: 2 U / (n m) - 1, which needs no pair of rows; 0 if a group is empty."""
    s = rank_sums(df, value, in_a, in_b)
    d = F.coalesce(F.try_divide(2 * F.col("u_a"), F.col("n_a").cast("double") * F.col("n_b")) - 1, F.lit(0.0))
    return s.select("n_a", "n_b", F.round(d, 6).alias("delta"), magnitude(d).alias("magnitude"))


def compare_groups(df: DataFrame, value: str, in_a: Column, in_b: Column, label_a: str, label_b: str) -> DataFrame:
    """One row: sizes, means and medians of two groups, U, p, whether p < 0.05, Cliff's delta and its magnitude; no row for an empty group."""
    s = rank_sums(df, value, in_a, in_b).first()
    if not s["n_a"] or not s["n_b"]:
        return df.sparkSession.createDataFrame([], "label_a string, label_b string, n_a long, n_b long, mean_a double, mean_b double, median_a double, median_b double, u double, p double, significant boolean, delta double, magnitude string")
    v = F.col(value).cast("double")
    m = df.agg(F.avg(F.when(in_a, v)).alias("mean_a"), F.avg(F.when(in_b, v)).alias("mean_b"), F.median(F.when(in_a, v)).alias("median_a"), F.median(F.when(in_b, v)).alias("median_b"))
    p = mann_whitney_p(s["n_a"], s["n_b"], s["u_a"], s["tie_term"])
    delta = 2 * s["u_a"] / (s["n_a"] * s["n_b"]) - 1
    return m.select(F.lit(label_a).alias("label_a"), F.lit(label_b).alias("label_b"), F.lit(s["n_a"]).cast("long").alias("n_a"), F.lit(s["n_b"]).cast("long").alias("n_b"), *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "median_a", "median_b")), F.lit(s["u_a"]).alias("u"), F.lit(p).alias("p"), F.lit(p < 0.05).alias("significant"), F.round(F.lit(delta), 6).alias("delta"), magnitude(F.lit(delta)).alias("magnitude"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: Pearson's correlation of average ranks."""
    rows = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y")), "pairs")
    rank = lambda c: cut(ranked_values(rows, c).select(F.col("value").alias(c), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}")), "ranks")
    return rows.join(rank("x"), "x").join(rank("y"), "y").agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho, p (two-sided, by Student's t with n - 2 degrees of freedom), significant, interpretation; p is null where rho is, or for fewer than three rows."""
    r = spearman(df, x, y).first()
    n, rho = r["n"], r["rho"]
    p = None
    if rho is not None and not math.isnan(rho) and n > 2:
        p = 0.0 if abs(rho) >= 1 else student_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    says = "significant negative correlation" if p is not None and p < 0.05 and rho < -0.3 else "weak/no correlation"
    return df.sparkSession.createDataFrame([(n, rho, p, p is not None and p < 0.05, says)], "n long, rho double, p double, significant boolean, interpretation string")


def compare_with_intervals(df: DataFrame, value: str, in_a: Column, in_b: Column, label_a: str, label_b: str, replicates: int = 10_000) -> DataFrame:
    """``compare_groups`` with bootstrap intervals of both means and of their difference; no row for an empty group."""
    one = compare_groups(df, value, in_a, in_b, label_a, label_b)
    a, b, d = bootstrap_ci(df.where(in_a), value, replicates), bootstrap_ci(df.where(in_b), value, replicates), bootstrap_difference(df, value, in_a, in_b, replicates)
    ends = lambda t, name: t.select(F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
    return one.crossJoin(ends(a, "mean_a")).crossJoin(ends(b, "mean_b")).crossJoin(ends(d, "difference"))


def group_definitions(sensational: DataFrame, robust: DataFrame) -> list[tuple[DataFrame, Column, Column, str, str]]:
    """The comparisons of the score tables: (scores, group a, group b, their labels)."""
    body, feeling, files = F.col("body_len"), F.col("emotional"), F.col("n_entries")
    return [
        (sensational, body < 200, body > 2000, "Clickbait (thin body <200ch)", "Clickbait (rich body >2000ch)"),
        (sensational, feeling >= 0.5, feeling == 0, "Clickbait (emotional title)", "Clickbait (neutral title)"),
        (robust, files == 1, files > 5, "Robustness (single file)", "Robustness (multi-file >5)"),
    ]


def run_all_tests(sensational: DataFrame, robust: DataFrame, intervals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row for each comparison whose groups both have rows, Spearman's test of the two composites over the bundles that both tables score)."""
    sensational, robust = cut(sensational, "sensational"), cut(robust, "robust")
    compare = compare_with_intervals if intervals else compare_groups
    rows = None
    for scores, a, b, la, lb in group_definitions(sensational, robust):
        one = compare(scores, "composite", a, b, la, lb)
        rows = one if rows is None else rows.unionByName(one)
    both = sensational.select("identifier", F.col("composite").alias("x")).join(robust.select("identifier", F.col("composite").alias("y")), "identifier")
    return rows, spearman_test(both, "x", "y")


def bootstrap_of(df: DataFrame, value: str, statistic, replicates: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """estimate, low, high of any statistic that is an aggregate of weighted values: ``statistic(value, weight)`` gives its column.

    ``lambda v, w: F.percentile(v, 0.5, w)`` is the median, ``lambda v, w:
    F.sum(v * w) / F.sum(w)`` the mean. A row weighs as a Poisson variable of
    mean 1 in each replicate, read off a hash of the row and the replicate;
    replicates are partial aggregates, so no task holds a whole resample.
    """
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    numbered = cut(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("i")), "values")
    drawn = numbered.select("v", "i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = F.pmod(F.xxhash64(F.lit(seed), "i", "replicate"), F.lit(1 << 52)) / float(1 << 52)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0)).cast("int")
    each = drawn.withColumn("w", weight).where("w > 0").groupBy("replicate").agg(statistic(F.col("v"), F.col("w")).alias("s"))
    tail = (1 - ci) / 2
    ends = each.agg(F.percentile("s", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return numbered.agg(statistic(F.col("v"), F.lit(1)).alias("estimate")).crossJoin(ends).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _poisson(replicates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.Generator(np.random.PCG64([seed, TaskContext.get().partitionId()]))
        n, s = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 1024):
                w = rng.poisson(1.0, (replicates, len(x[a : a + 1024])))
                n += w.sum(1)
                s += w @ x[a : a + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(n), pa.array(s)], names=["replicate", "n", "s"])

    return run


def bootstrap_means(df: DataFrame, value: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """replicate, mean: resampled means, each row drawn as often as a Poisson variable of mean 1 says. A task sends one row for each replicate, whatever it reads."""
    got = df.select(F.col(value).cast("double").alias("v")).mapInArrow(_poisson(replicates, seed), "replicate long, n double, s double")
    return got.groupBy("replicate").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))


def bootstrap_ci(df: DataFrame, value: str, replicates: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """mean, low, high."""
    tail = (1 - ci) / 2
    ends = bootstrap_means(df, value, replicates, seed).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return df.agg(F.avg(F.col(value).cast("double")).alias("mean")).crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_difference(df: DataFrame, value: str, in_a: Column, in_b: Column, replicates: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """difference, low, high of the means of two groups."""
    a, b = bootstrap_means(df.where(in_a), value, replicates, seed).withColumnRenamed("mean", "a"), bootstrap_means(df.where(in_b), value, replicates, seed + 1).withColumnRenamed("mean", "b")
    tail, v = (1 - ci) / 2, F.col(value).cast("double")
    ends = a.join(b, "replicate").agg(F.percentile(F.col("a") - F.col("b"), F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return df.agg((F.avg(F.when(in_a, v)) - F.avg(F.when(in_b, v))).alias("difference")).crossJoin(ends).select("difference", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
