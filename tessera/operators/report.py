"""Reports of training, comparison, importance and residuals, and searches over parameters."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS, normal_cdf
from tessera.operators.frame import positions


@dataclass
class TrainingLog:
    """Epochs of a training run."""

    rows: list[tuple] = field(default_factory=list)

    def add_epoch(self, train_loss: float, val_loss: float, train_metric: float = 0.0, val_metric: float = 0.0, rate: float = 0.0) -> None:
        self.rows.append((len(self.rows), float(train_loss), float(val_loss), float(train_metric), float(val_metric), float(rate)))

    @property
    def best(self) -> int:
        """Epoch of the least validation loss, -1 without any."""
        return min(self.rows, key=lambda r: (r[2], r[0]))[0] if self.rows else -1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "epoch int, train_loss double, val_loss double, train_metric double, val_metric double, rate double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).select("epoch", "train_loss", "val_loss").coalesce(1).write.csv(path, header=True)

    def summary(self) -> str:
        return f"{len(self.rows)} epochs, best {self.best}"


@dataclass
class ModelReport:
    name: str
    metrics: dict[str, float]

    def summary(self) -> str:
        return f"{self.name}: " + ", ".join(f"{k}={v:.4f}" for k, v in self.metrics.items())

    def csv_row(self) -> str:
        return ",".join([self.name, *(f"{v:.6f}" for v in self.metrics.values())])


def comparison(spark: SparkSession, reports: Sequence[ModelReport]) -> DataFrame:
    """A row a model, a column a metric."""
    names = list(dict.fromkeys(k for r in reports for k in r.metrics))
    schema = ", ".join(["model string", *(f"`{n}` double" for n in names)])
    return spark.createDataFrame([(r.name, *(float(r.metrics[n]) if n in r.metrics else None for n in names)) for r in reports], schema)


def save(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.csv(path, header=True)


def permutation_importance(df: DataFrame, columns: Sequence[str], key: str, predict: Callable[[], Column], metric: Callable[[Column], Column], repeats: int = 3, seed: int = 0, buckets: int = 64) -> DataFrame:
    """How much a metric loses when a column is dealt anew. Values move to the next row of a hashed order
    within hash buckets, so no window holds all rows."""
    base = df.agg(metric(predict()).alias("m")).first()[0]
    out = []
    for c in columns:
        lost = []
        for k in range(repeats):
            bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(key)), F.lit(buckets))
            w = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), F.lit(k), F.col(key)), key)
            whole = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), F.lit(k), F.col(key)), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            moved = df.withColumn("_b", bucket).withColumn(c, F.coalesce(F.lead(c).over(w), F.first(c).over(whole)))
            lost.append(base - moved.agg(metric(predict()).alias("m")).first()[0])
        out.append((c, float(np.mean(lost)), float(np.std(lost))))
    return df.sparkSession.createDataFrame(out, "feature string, importance double, spread double").orderBy(F.desc("importance"))


def residuals(df: DataFrame, truth: str, guess: str, order: Sequence[str]) -> DataFrame:
    """Mean and spread of residuals, Durbin-Watson, p of a zero mean, and whether the variance of the later
    half differs by more than twice. Rows are placed by ranges and meet the row before by its place."""
    e = (F.col(truth) - F.col(guess)).alias("e")
    placed = positions(df.select(e, *order), order, "at").select("e", "at")
    half = F.broadcast(placed.agg(F.ceil(F.count("*") / 2).alias("half")))  # one row
    before = placed.select(F.col("e").alias("b"), (F.col("at") + 1).alias("at"))
    rows = placed.join(before, "at", "left").join(half).select("e", "b", F.when(F.col("at") < F.col("half"), 1).otherwise(2).alias("half"))
    one = rows.agg(
        F.avg("e").alias("mean"),
        F.stddev_samp("e").alias("std"),
        (F.sum((F.col("e") - F.col("b")) * (F.col("e") - F.col("b"))) / (F.sum(F.col("e") * F.col("e")) + EPS)).alias("durbin_watson"),
        F.count("e").alias("n"),
        F.var_samp(F.when(F.col("half") == 1, F.col("e"))).alias("v1"),
        F.var_samp(F.when(F.col("half") == 2, F.col("e"))).alias("v2"),
    )
    z = F.abs(F.col("mean") / (F.col("std") / F.sqrt("n") + EPS))
    ratio = F.col("v2") / (F.col("v1") + EPS)
    return one.select("mean", "std", "durbin_watson", (2 * (1 - normal_cdf(z))).alias("mean_p"), ((ratio < 0.5) | (ratio > 2)).alias("heteroscedastic"))


def learning_curve(df: DataFrame, key: str, sizes: Sequence[float], fit_score: Callable[[DataFrame], float]) -> DataFrame:
    """Score of a fit on growing shares of the rows, nested by a hash of the key."""
    share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1e6
    return df.sparkSession.createDataFrame([(float(s), float(fit_score(df.where(share < s)))) for s in sizes], "share double, score double")


def cross_validate(df: DataFrame, folds: int, fit_score: Callable[[DataFrame, DataFrame], float], fold: str = "fold") -> DataFrame:
    """Score of each fold by a function of (train, validation)."""
    rows = [(k, float(fit_score(df.where(F.col(fold) != k), df.where(F.col(fold) == k)))) for k in range(folds)]
    return df.sparkSession.createDataFrame(rows, "fold int, score double")


@dataclass
class Range:
    """A parameter: between bounds (whole numbers if `whole`), or one of the choices."""

    name: str
    low: float = 0.0
    high: float = 1.0
    whole: bool = False
    choices: Sequence[float] = ()

    def at(self, u: float) -> float:
        if self.choices:
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        v = self.low + u * (self.high - self.low)
        return round(v) if self.whole else v


def trials(spark: SparkSession, rows: Sequence[tuple[dict, float, float]], minimise: bool) -> DataFrame:
    frame = spark.createDataFrame([(k, {n: float(v) for n, v in p.items()}, float(s), float(t)) for k, (p, s, t) in enumerate(rows)], "trial int, params map<string,double>, score double, seconds double")
    return frame.orderBy(F.asc("score") if minimise else F.desc("score"), "trial")


def run(params: dict, objective: Callable[[dict], float]) -> tuple[dict, float, float]:
    start = time.time()
    return params, objective(params), time.time() - start


def random_search(spark: SparkSession, ranges: Sequence[Range], objective: Callable[[dict], float], n: int = 20, minimise: bool = True, seed: int = 0) -> DataFrame:
    rng = np.random.default_rng(seed)
    return trials(spark, [run({r.name: r.at(rng.random()) for r in ranges}, objective) for _ in range(n)], minimise)


def grid_search(spark: SparkSession, grid: dict[str, Sequence[float]], objective: Callable[[dict], float], minimise: bool = True) -> DataFrame:
    return trials(spark, [run(dict(zip(grid, v)), objective) for v in itertools.product(*grid.values())], minimise)


def bayesian_search(spark: SparkSession, ranges: Sequence[Range], objective: Callable[[dict], float], n: int = 20, first: int = 5, minimise: bool = True, seed: int = 0) -> DataFrame:
    """Gaussian process with expected improvement over random candidates."""
    rng, seen, rows = np.random.default_rng(seed), [], []
    for k in range(n):
        u = rng.random(len(ranges))
        if k >= first:
            x, y = np.array(seen), np.array([r[1] if minimise else -r[1] for r in rows])
            y = (y - y.mean()) / (y.std() + 1e-9)
            kern = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.08)
            inv = np.linalg.inv(kern(x, x) + 1e-4 * np.eye(len(x)))
            c = rng.random((256, len(ranges)))
            kc = kern(c, x)
            mu, sd = kc @ inv @ y, np.sqrt(np.maximum(1e-9, 1 - np.einsum("ij,jk,ik->i", kc, inv, kc)))
            z = (y.min() - mu) / sd
            ei = sd * (z * 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in z]) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
            u = c[int(ei.argmax())]
        seen.append(u)
        rows.append(run({r.name: r.at(float(v)) for r, v in zip(ranges, u)}, objective))
    return trials(spark, rows, minimise)


def as_text(title: str, rows: Sequence[Sequence[object]], head: Sequence[str], places: int = 4) -> str:
    """A title and aligned columns, numbers with `places` decimals."""
    said = [list(head), *([f"{v:.{places}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows)]
    wide = [max(len(r[c]) for r in said) for c in range(len(head))]
    lines = ["  ".join(v.ljust(w) if not k else v.rjust(w) for k, (v, w) in enumerate(zip(r, wide))).rstrip() for r in said]
    return "\n".join([title, *lines]) + "\n"


def frame_text(title: str, df: DataFrame, most: int = 1000) -> str:
    """Text of a report's frame (a row a class, feature, model, column, fold or trial), `most` rows of it."""
    rows = df.limit(most).collect()
    return as_text(title, [[", ".join(f"{k}={v:.4g}" for k, v in sorted(x.items())) if isinstance(x, dict) else x for x in r] for r in rows], df.columns)


def confusion_text(rates: DataFrame) -> str:
    """The four counts as a square, and what follows from them. rates: as metrics.rates gives them."""
    r = rates.first().asDict()
    square = as_text("confusion matrix", [("true 1", r["tp"], r["fn"]), ("true 0", r["fp"], r["tn"])], ["", "said 1", "said 0"])
    return square + "".join(f"{k}: {r[k]:.4f}\n" for k in ("accuracy", "precision", "recall", "f1", "specificity", "mcc", "kappa"))


def class_report_text(report: DataFrame, means: DataFrame) -> str:
    """Rows by class, then the means. report and means: as metrics.classification_report and report_means give them."""
    tail = means.first().asDict()
    return frame_text("classes", report.orderBy("class")) + "".join(f"{k}: {v:.4f}\n" for k, v in tail.items())


def folds_text(scores: DataFrame) -> str:
    """Scores by fold, their mean and spread. scores: as cross_validate gives them."""
    s = [r["score"] for r in scores.orderBy("fold").collect()]
    return as_text("folds", list(enumerate(s)), ["fold", "score"]) + f"mean: {np.mean(s):.4f}\nspread: {np.std(s, ddof=min(1, len(s) - 1)):.4f}\n"


def search_text(found: DataFrame) -> str:
    """Trials, best first, and the best one's parameters. found: as a search gives it."""
    best = found.first()
    head = f"best: trial {best['trial']}, score {best['score']:.4f}, " + ", ".join(f"{k}={v:.4g}" for k, v in sorted(best["params"].items()))
    return frame_text("trials", found.drop("seconds")) + head + "\n"


def residuals_text(found: DataFrame) -> str:
    """What `residuals` tells, a line each."""
    return "residuals\n" + "".join(f"{k}: {v:.4f}\n" if isinstance(v, float) else f"{k}: {v}\n" for k, v in found.first().asDict().items())
