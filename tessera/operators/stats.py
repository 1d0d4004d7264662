"""Descriptive statistics and hypothesis tests: one-row frames made by few aggregates each.

p-values are the closed forms of tessera.functions.scalars.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS, chi2_upper, normal_cdf, normal_quantile, t_cdf
from tessera.operators.frame import kurtosis, running, skewness
from tessera.operators.quantiles import quantiles



def two_sided(p: Column) -> Column:
    """Two-sided p from the upper tail, held within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * p))


def test(statistic: Column, p: Column, df: Column) -> list[Column]:
    return [statistic.alias("statistic"), p.alias("p_value"), df.cast("double").alias("df")]


def reject_null(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha


def summary_text(name: str) -> Column:
    return F.format_string(f"{name}: statistic=%.4f p=%.4f", "statistic", "p_value")


def summary(df: DataFrame, column: str) -> DataFrame:
    """mean, variance (sample and population), std, median, iqr, skewness, kurtosis."""
    c = F.col(column)
    zero = F.lit(0.0)
    q1, q2, q3 = quantiles(df, {column: c}, (0.25, 0.5, 0.75))[column]
    return df.agg(
        F.coalesce(F.avg(c), zero).alias("mean"),
        F.coalesce(F.var_samp(c), zero).alias("variance"),
        F.coalesce(F.var_pop(c), zero).alias("variance_pop"),
        F.coalesce(F.stddev_samp(c), zero).alias("std"),
        F.lit(0.0 if q2 is None else q2).alias("median"),
        F.lit(0.0 if q2 is None else q3 - q1).alias("iqr"),
        skewness(c).alias("skewness"),
        kurtosis(c).alias("kurtosis"),
    )


def pearson(x: Column, y: Column) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def average_ranks(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean: distinct values are counted before they are ranked, and
    without keys summed by ranges, so no window holds all of them."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    if not by:
        up = running(counts, [F.col(column).asc_nulls_first()], {"_up": F.col("_n")})
        return df.join(up.select(column, (F.col("_up") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out)), column, "left")
    w = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*by, column, (F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, column], "left")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = average_ranks(average_ranks(both, x, "_rx"), y, "_ry")
    return ranked.agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def entropy(df: DataFrame, probability: str) -> DataFrame:
    """Bits; only positive probabilities count."""
    p = F.col(probability)
    return df.where(p > 0).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def binned(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0; the top value falls into the last."""
    return F.least(F.floor((c - low) / ((high - low + EPS) / bins)), F.lit(bins - 1)).cast("int")


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10, bin_y: bool = True) -> DataFrame:
    """Bits over a joint equal-width histogram; y as it is with bin_y=False."""
    edges = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"), F.min(y).alias("_c"), F.max(y).alias("_d"))
    cells = df.select(x, y).join(F.broadcast(edges))  # one row
    by = binned(F.col(y), F.col("_c"), F.col("_d"), bins) if bin_y else F.col(y)
    joint = cells.select(binned(F.col(x), F.col("_a"), F.col("_b"), bins).alias("bx"), by.alias("by")).groupBy("bx", "by").agg(F.count("*").alias("n"))
    every, px, py = Window.partitionBy(), Window.partitionBy("bx"), Window.partitionBy("by")
    p = lambda w: F.sum("n").over(w) / F.sum("n").over(every)
    rows = joint.select((F.col("n") / F.sum("n").over(every)).alias("p"), p(px).alias("x"), p(py).alias("y"))
    return rows.agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("x") * F.col("y")))).alias("mutual_information"))


def t_test_one_sample(df: DataFrame, column: str, mu: float = 0.0) -> DataFrame:
    one = df.agg(F.count(column).cast("double").alias("n"), F.avg(column).alias("m"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("s"))
    t = (F.col("m") - mu) / (F.col("s") / F.sqrt("n") + EPS)
    one = one.withColumn("t", t).withColumn("df", F.col("n") - 1)
    return one.select(*test(F.col("t"), two_sided(1 - t_cdf(F.abs("t"), F.col("df"))), F.col("df")))


def t_test_two_sample(df: DataFrame, column: str, group: str, first: object, second: object, equal_var: bool = True) -> DataFrame:
    """Pooled, or Welch with whole degrees of freedom."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(column)))
    cols = [of(f, g).alias(f"{n}{k}") for k, g in ((1, first), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    one = df.agg(*cols).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    if equal_var:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se, free = F.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
    else:
        a, b = v1 / n1, v2 / n2
        se = F.sqrt(a + b)
        free = F.floor((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1) + EPS))
    one = one.withColumn("t", (F.col("m1") - F.col("m2")) / (se + EPS)).withColumn("df", free.cast("double"))
    return one.select(*test(F.col("t"), two_sided(1 - t_cdf(F.abs("t"), F.col("df"))), F.col("df")))


def t_test_paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return t_test_one_sample(df.select((F.col(x) - F.col(y)).alias("d")), "d")


def chi_squared(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """Goodness of fit over the rows' cells."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    one = df.agg(F.sum((o - e) * (o - e) / (e + EPS)).alias("x"), (F.count("*") - 1).cast("double").alias("df"))
    return one.select(*test(F.col("x"), chi2_upper(F.col("x"), F.col("df")), F.col("df")))


def anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """F of between over within; the tail by the square root's normal approximation."""
    g = df.where(F.col(column).isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(column).alias("m"), F.coalesce(F.var_pop(column), F.lit(0.0)).alias("v"))
    n, m = F.col("n"), F.col("m")
    one = g.agg(F.count("*").cast("double").alias("k"), F.sum(n).alias("total"), F.sum(n * m).alias("s"), F.sum(n * m * m).alias("q"), F.sum(n * F.col("v")).alias("w"))
    between = (F.col("q") - F.col("s") * F.col("s") / F.col("total")) / (F.col("k") - 1)
    within = F.col("w") / (F.col("total") - F.col("k"))
    one = one.withColumn("f", between / (within + EPS))
    return one.select(*test(F.col("f"), 1 - normal_cdf(F.sqrt("f")), F.col("k") - 1))


def mann_whitney(df: DataFrame, column: str, group: str, first: object, second: object) -> DataFrame:
    """U with average ranks; normal approximation without corrections."""
    both = df.where(F.col(group).isin(first, second) & F.col(column).isNotNull())
    ranked = average_ranks(both.select(column, group), column, "_r")
    one = ranked.agg(F.sum(F.when(F.col(group) == first, F.col("_r"))).alias("r"), F.count_if(F.col(group) == first).cast("double").alias("n1"), F.count_if(F.col(group) == second).cast("double").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r") - n1 * (n1 + 1) / 2
    one = one.withColumn("u", F.least(u1, n1 * n2 - u1))
    z = (F.col("u") - n1 * n2 / 2) / (F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12) + EPS)
    return one.select(*test(F.col("u"), two_sided(1 - normal_cdf(F.abs(z))), F.lit(0)))


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Largest gap between the empirical and the fitted normal distribution, and its asymptotic p."""
    one = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count(column).cast("double").alias("_n"))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c")).join(F.broadcast(one))
    counts, up = running(counts, [F.col(column)], {"_up": F.col("_c")}), F.col("_up")
    cdf = normal_cdf((F.col(column) - F.col("_m")) / (F.col("_s") + EPS))
    gap = F.greatest(F.abs(up / F.col("_n") - cdf), F.abs((up - F.col("_c")) / F.col("_n") - cdf))
    d = counts.select(gap.alias("g"), "_n").agg(F.max("g").alias("d"), F.max("_n").alias("n"))
    x = F.col("d") * (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n"))
    series = sum((F.exp(x * x * (-2.0 * k * k)) * (2.0 * (-1) ** (k - 1)) for k in range(2, 6)), F.exp(x * x * -2.0) * 2.0)
    return d.select(*test(F.col("d"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)), F.lit(0)))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and p of a bounded sample (3 to 5000 values), by Royston's normalising polynomials."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([quantile_of((k - 0.375) / (n + 0.25)) for k in range(1, n + 1)])
    u, total = 1 / math.sqrt(n), float(m @ m)
    last = m[-1] / math.sqrt(total) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    a = m / math.sqrt(total)
    if n > 5:
        before = m[-2] / math.sqrt(total) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, before, -last, -before
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    y = math.log(max(1e-12, 1 - w))
    if n <= 11:
        g = 0.459 * n - 2.273
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        y = -math.log(max(1e-12, g - y))
    else:
        k = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def quantile_of(p: float) -> float:
    """Standard normal quantile by bisection of the error function."""
    low, high = -9.0, 9.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def gamma_func(x: float) -> float:
    return math.gamma(x)


def beta_func(a: float, b: float) -> float:
    return math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def regularized_beta(x: float, a: float, b: float, steps: int = 300) -> float:
    """I_x(a, b) by the continued fraction, evaluated from its tail."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_beta(1 - x, b, a, steps)
    tail = 0.0
    for m in range(steps, 0, -1):
        k = m // 2
        d = k * (b - k) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        tail = d / (1 + tail)
    return x**a * (1 - x) ** b / (a * beta_func(a, b)) / (1 + tail)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return regularized_beta(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def chi2_cdf(x: float, df: float) -> float:
    """Series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 10_000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def interval_mean(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """Mean and normal interval."""
    one = df.agg(F.avg(column).alias("m"), (F.stddev_samp(column) / F.sqrt(F.count(column))).alias("se"))
    z = normal_quantile(F.lit(1 - (1 - confidence) / 2))
    return one.select(F.col("m").alias("estimate"), (F.col("m") - z * F.col("se")).alias("low"), (F.col("m") + z * F.col("se")).alias("high"))


def interval_proportion(df: DataFrame, condition: Column, confidence: float = 0.95) -> DataFrame:
    """Share of rows and Wald interval."""
    one = df.agg(F.avg(condition.cast("double")).alias("p"), F.count("*").cast("double").alias("n"))
    z, p = normal_quantile(F.lit(1 - (1 - confidence) / 2)), F.col("p")
    se = F.sqrt(p * (1 - p) / F.col("n"))
    return one.select(p.alias("estimate"), (p - z * se).alias("low"), (p + z * se).alias("high"))


def bootstrap_means(df: DataFrame, column: str, key: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """Mean of each replicate. Rows get Poisson(1) weights from a hash of key and replicate, so nothing
    is collected and a rerun gives the same; the weighted sums combine before the shuffle."""
    u = (F.xxhash64(F.lit(seed), F.col(key), F.col("replicate")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    steps, mass, cdf = [], math.exp(-1), 0.0
    for k in range(1, 12):
        cdf += mass
        mass /= k
        steps.append((u >= cdf).cast("int"))
    weight = sum(steps[1:], steps[0])
    rows = df.where(F.col(column).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", weight)
    return rows.groupBy("replicate").agg((F.sum(F.col(column) * F.col("_w")) / F.sum("_w")).alias("mean"))


def bootstrap_interval(df: DataFrame, column: str, key: str, replicates: int = 100, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    means = bootstrap_means(df, column, key, replicates, seed)
    tail = (1 - confidence) / 2
    return means.agg(F.avg("mean").alias("estimate"), F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def bootstrap_statistic(df: DataFrame, column: str, statistic: Callable[[np.ndarray], float], replicates: int = 100, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """Any statistic of resamples of a bounded sample of `rows` values; a task a replicate."""
    spark = df.sparkSession
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("double")).orderBy(F.xxhash64(column)).limit(rows).collect()]
    held = spark.sparkContext.broadcast(np.array(values))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["replicate"].iloc[0])
        got = np.random.default_rng((seed, k)).choice(held.value, len(held.value)) if len(held.value) else np.zeros(0)
        return pd.DataFrame({"replicate": [k], "value": [float(statistic(got))]})

    return spark.range(replicates).withColumnRenamed("id", "replicate").groupBy("replicate").applyInPandas(run, "replicate bigint, value double")
