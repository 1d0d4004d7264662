"""Series by a time key, optionally many of them by partition keys."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS
from tessera.operators.frame import kurtosis, skewness
from tessera.operators.ordered import simple_moving_average, spec


def numbered(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, F.col(value).cast("double").alias("x"), *order, (F.row_number().over(spec(order, by)) - 1).alias("i"))


def autocorrelation(df: DataFrame, value: str, order: Sequence[str], lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Biased estimate for lags 0..lags, in one window and one aggregate."""
    w = spec(order, by)
    mean = F.avg("x").over(Window.partitionBy(*by))
    rows = df.select(*by, *order, F.col(value).cast("double").alias("x")).withColumn("d", F.col("x") - mean)
    rows = rows.select(*by, "d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    whole = F.sum(F.col("d") * F.col("d"))
    one = rows.groupBy(*by).agg(F.lit(1.0).alias("acf0"), *((F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)) / whole).alias(f"acf{k}") for k in range(1, lags + 1)))
    return one.select(*by, F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"acf{k}").alias("acf")) for k in range(lags + 1)))))


def partial_autocorrelation(acf: Sequence[float]) -> list[float]:
    """Durbin-Levinson recursion over a few autocorrelations."""
    out, phi = [1.0], np.zeros(0)
    for k in range(1, len(acf)):
        r = np.asarray(acf[1:k])
        top = acf[k] - float(phi @ r[::-1])
        a = top / (1 - float(phi @ r) + EPS)
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def seasonal_decompose(df: DataFrame, value: str, order: Sequence[str], period: int, model: str = "additive", by: Sequence[str] = ()) -> DataFrame:
    """trend (trailing mean over the period), seasonal (mean detrended value by phase), residual."""
    rows = numbered(df, value, order, by)
    rows = rows.withColumn("trend", simple_moving_average(F.col("x"), spec(order, by), period))
    plus = model == "additive"
    rows = rows.withColumn("_d", F.col("x") - F.col("trend") if plus else F.col("x") / F.nullif(F.col("trend"), F.lit(0.0)))
    rows = rows.withColumn("seasonal", F.avg("_d").over(Window.partitionBy(*by, F.col("i") % period)))
    rest = F.col("_d") - F.col("seasonal") if plus else F.col("_d") / F.nullif(F.col("seasonal"), F.lit(0.0))
    return rows.withColumn("residual", rest).drop("_d")


def change_points(df: DataFrame, value: str, order: Sequence[str], least: int = 5, penalty: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Gain n Var - n_l Var_l - n_r Var_r - penalty of each split; from running sums, in linear time."""
    before = spec(order, by).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    rows = numbered(df, value, order, by)
    s, q = F.col("s"), F.col("q")
    rows = rows.select("*", F.sum("x").over(before).alias("s"), F.sum(F.col("x") * F.col("x")).over(before).alias("q"), F.sum("x").over(every).alias("total"), F.count("*").over(every).alias("n"))
    i, n = F.col("i"), F.col("n")
    gain = s * s / i + (F.col("total") - s) * (F.col("total") - s) / (n - i) - F.col("total") * F.col("total") / n - penalty
    found = rows.where((i >= least) & (i < n - least)).select(*by, "i", gain.alias("score"))
    return found.where("score > 0")


def features(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moments, autocorrelation at 1 and 5, crossings of the mean, longest run above it, 10-bin entropy."""
    w, every = spec(order, by), Window.partitionBy(*by)
    rows = numbered(df, value, order, by).withColumn("m", F.avg("x").over(every)).withColumns({"lo": F.min("x").over(every), "hi": F.max("x").over(every)})
    rows = rows.withColumn("up", (F.col("x") > F.col("m")).cast("int"))
    rows = rows.withColumn("cross", (F.col("up") != F.lag("up").over(w)).cast("int")).withColumn("run", F.sum(F.coalesce("cross", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = F.col("x") - F.col("m")
    rows = rows.withColumns({"d": d, "bin": F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo") + EPS) / 10)), F.lit(9))})
    rows = rows.withColumns({"d1": F.lag("d", 1).over(w), "d5": F.lag("d", 5).over(w)})
    acf = lambda c: F.coalesce(F.sum(F.col("d") * F.col(c)) / F.sum(F.col("d") * F.col("d")), F.lit(0.0))
    n = F.count("*").cast("double")
    bins = [F.count_if(F.col("bin") == k) / n for k in range(10)]
    bits = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in bins), F.lit(0.0))
    main = rows.groupBy(*by).agg(
        F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.median("x").alias("median"),
        skewness("x").alias("skewness"), kurtosis("x").alias("kurtosis"), acf("d1").alias("acf1"), acf("d5").alias("acf5"),
        F.coalesce(F.sum("cross"), F.lit(0)).alias("crossings"), bits.alias("entropy"),
    )
    runs = rows.where("up = 1").groupBy(*by, "run").agg(F.count("*").alias("c")).groupBy(*by).agg(F.max("c").alias("longest_run"))
    joined = main.join(runs, list(by), "left") if by else main.join(F.broadcast(runs), how="left")  # one row each
    return joined.withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))


def adf_statistic(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """t of the slope in: difference = a + b level before; one aggregate after one lag."""
    rows = df.select(*order, F.col(value).cast("double").alias("x")).withColumn("l", F.lag("x").over(spec(order))).where("l is not null")
    y, x, n = F.col("x") - F.col("l"), F.col("l"), F.count("*").cast("double")
    one = rows.agg(F.regr_slope(y, x).alias("b"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), n.alias("n"))
    se = F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return one.select((F.col("b") / se).alias("statistic"), (F.col("b") / se < -2.86).alias("stationary"))


@dataclass
class HoltWinters:
    """Level, trend and season after the last value, and the fitted values."""

    level: float
    trend: float
    season: list[float]
    fitted: list[float]
    sse: float

    def predict(self, steps: int) -> list[float]:
        p = len(self.season)
        return [self.level + (h + 1) * self.trend + self.season[(len(self.fitted) + h) % p] for h in range(steps)]


def holt_winters(x: Sequence[float], period: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1) -> HoltWinters:
    """Additive smoothing of one bounded series; use under applyInPandas for many."""
    x = [float(v) for v in x]
    first = x[:period]
    level = sum(first) / max(1, len(first))
    second = x[period : 2 * period]
    trend = (sum(second) / len(second) - level) / period if second else 0.0
    season = [v - level for v in first] or [0.0]
    fitted = []
    for i, v in enumerate(x):
        s = season[i % len(season)]
        fitted.append(level + trend + s)
        new = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        season[i % len(season)] = gamma * (v - new) + (1 - gamma) * s
        level = new
    return HoltWinters(level, trend, season, fitted, sum((a - b) ** 2 for a, b in zip(x, fitted)))


@dataclass
class Arima:
    """AR and MA weights and constant of the differenced series, with its end."""

    ar: np.ndarray
    ma: np.ndarray
    const: float
    heads: list[float]
    past: list[float]
    errors: list[float]
    sigma2: float

    def predict(self, steps: int) -> list[float]:
        past, errors, out = list(self.past), list(self.errors), []
        for _ in range(steps):
            v = self.const + sum(a * past[-k - 1] for k, a in enumerate(self.ar)) + sum(b * errors[-k - 1] for k, b in enumerate(self.ma))
            past.append(v)
            errors.append(0.0)
            out.append(v)
        for last in reversed(self.heads):
            out = list(np.cumsum(out) + last)
        return [float(v) for v in out]


def fit_arima(x: Sequence[float], p: int = 1, d: int = 0, q: int = 0) -> Arima:
    """Hannan-Rissanen: a long autoregression gives the shocks, least squares the weights."""
    y, heads = np.asarray(x, dtype=float), []
    for _ in range(d):
        heads.append(float(y[-1]))
        y = np.diff(y)

    def design(lags: list[tuple[np.ndarray, int]], start: int) -> np.ndarray:
        return np.column_stack([np.ones(len(y) - start), *(s[start - k : len(y) - k] for s, n in lags for k in range(1, n + 1))])

    shocks = np.zeros(len(y))
    if q:
        m = min(max(p + q, int(math.log(len(y)) ** 1.5) + 1), len(y) // 3)
        a = design([(y, m)], m)
        shocks[m:] = y[m:] - a @ np.linalg.lstsq(a, y[m:], rcond=None)[0]
    start = max(p, q, 1)
    a = design([(y, p), (shocks, q)], start)
    w = np.linalg.lstsq(a, y[start:], rcond=None)[0]
    left = y[start:] - a @ w
    return Arima(w[1 : 1 + p], w[1 + p :], float(w[0]), heads, list(y[-max(p, 1) :]), list(left[-max(q, 1) :]), float(left.var()))


def seasonal_difference(c: Column, order: Sequence[str], period: int, by: Sequence[str] = ()) -> Column:
    return c - F.lag(c, period).over(spec(order, by))
