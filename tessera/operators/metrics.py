"""Model metrics over a frame of truth and prediction columns. Every function gives a one-row frame, or
a curve, from one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS
from tessera.operators.frame import running
from tessera.operators.quantiles import quantiles


def regression(df: DataFrame, truth: str, guess: str, features: int = 1) -> DataFrame:
    """mse, rmse, mae, mape, r2, adjusted r2, explained variance, max error, median absolute error."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    n = F.count("*").cast("double")
    sse, sst = F.sum(e * e), F.var_pop(y) * n
    r2 = F.when(sst > 0, 1 - sse / sst).otherwise(0.0)
    return df.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.coalesce(F.avg(F.when(y != 0, F.abs(e / y))) * 100, F.lit(0.0)).alias("mape"),
        r2.alias("r2"),
        (1 - (1 - r2) * (n - 1) / (n - features - 1)).alias("adjusted_r2"),
        (1 - F.var_pop(e) / (F.var_pop(y) + EPS)).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
        F.lit(quantiles(df, {"e": F.abs(e)}, (0.5,))["e"][0]).cast("double").alias("median_absolute_error"),
    )


def confusion(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn; truth is 1 from 0.5 on."""
    y, p = F.col(truth) >= 0.5, F.col(score) >= threshold
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def rates(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """What follows from the four counts."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    precision, recall = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    accuracy = (tp + tn) / (total + EPS)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (total * total + EPS)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    b2 = beta * beta
    return counts.select(
        "tp", "fp", "tn", "fn",
        total.alias("total"),
        accuracy.alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        (2 * precision * recall / (precision + recall + EPS)).alias("f1"),
        ((1 + b2) * precision * recall / (b2 * precision + recall + EPS)).alias("fbeta"),
        (tn / (tn + fp + EPS)).alias("specificity"),
        (tn / (tn + fn + EPS)).alias("npv"),
        ((tp * tn - fp * fn) / (F.sqrt(product) + EPS)).alias("mcc"),
        ((accuracy - chance) / (1 - chance + EPS)).alias("kappa"),
    )


def log_loss(df: DataFrame, truth: str, score: str, clip: float = 1e-7) -> DataFrame:
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(score)))
    return df.agg(F.avg(-(F.col(truth) * F.log(p) + (1 - F.col(truth)) * F.log(1 - p))).alias("log_loss"))


def steps(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Counts by distinct score from the top: rows, positives, and both cumulated. Scores are grouped
    before they are ordered, so equal scores share a step; ranges of scores are summed, no window holds all."""
    by = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) >= 0.5).alias("p"), F.count("*").alias("n"))
    every = F.broadcast(df.agg(F.count_if(F.col(truth) >= 0.5).alias("all_p"), F.count("*").alias("all_n")))  # one row
    return running(by, [F.desc("score")], {"tp": F.col("p"), "seen": F.col("n")}).join(every).select("score", "p", "n", "tp", "seen", "all_p", "all_n")


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """fpr and tpr by threshold, without the point (0, 0)."""
    s = steps(df, truth, score)
    return s.select(F.col("score").alias("threshold"), ((F.col("seen") - F.col("tp")) / (F.col("all_n") - F.col("all_p"))).alias("fpr"), (F.col("tp") / F.col("all_p")).alias("tpr"))


def auc_roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve: of each positive, the negatives below it and half of those beside it."""
    s = steps(df, truth, score)
    negatives = F.col("n") - F.col("p")
    below = F.col("all_n") - F.col("all_p") - (F.col("seen") - F.col("tp"))
    return s.agg((F.sum(F.col("p") * (below + negatives / 2)) / F.max(F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("auc_roc"))


def pr_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    s = steps(df, truth, score)
    return s.select(F.col("score").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.col("all_p")).alias("recall"))


def auc_pr(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Trapezoids from the curve's first point. A step's own counts tell the point before it."""
    s = steps(df, truth, score)
    precision, recall = F.col("tp") / F.col("seen"), F.col("tp") / F.col("all_p")
    r0, p0 = (F.col("tp") - F.col("p")) / F.col("all_p"), (F.col("tp") - F.col("p")) / F.nullif(F.col("seen") - F.col("n"), F.lit(0))
    return s.agg(F.coalesce(F.sum(F.abs(recall - r0) * (precision + p0) / 2), F.lit(0.0)).alias("auc_pr"))


def classification_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """precision, recall, f1 and support of each class of the truth."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    guessed = cells.groupBy("g").agg(F.sum("n").alias("guessed"))
    own = cells.groupBy("t").agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("t") == F.col("g"), F.col("n"))), F.lit(0)).alias("hit"))
    j = own.join(guessed, own["t"] == guessed["g"], "left")
    hit = F.col("hit").cast("double")
    p, r = hit / (F.coalesce("guessed", F.lit(0)) + EPS), hit / (F.col("support") + EPS)
    return j.select(F.col("t").alias("class"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + EPS)).alias("f1"), "support")


def report_means(report: DataFrame) -> DataFrame:
    """Macro means and the f1 weighted by support."""
    return report.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def confusion_multi(df: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """classes x classes counts; others are left out."""
    rows = df.where(F.col(truth).between(0, classes - 1) & F.col(guess).between(0, classes - 1))
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(truth))
    counts = rows.groupBy(F.col(truth).cast("int").alias(truth)).agg(*(F.count_if(F.col(guess) == k).alias(f"c{k}") for k in range(classes)))
    return grid.join(counts, truth, "left").select(F.col(truth).alias("class"), *(F.coalesce(f"c{k}", F.lit(0)).alias(f"c{k}") for k in range(classes)))


def ndcg(df: DataFrame, relevance: str, order: Sequence[Column | str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Gain 2^rel - 1, discount log2(place + 1), the first k; 0 without any gain. Only k rows a query and
    ranking survive each window."""

    def gains(keys: Sequence[Column | str], name: str) -> DataFrame:
        placed = df.select(*df.columns, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).alias("_k")).where(F.col("_k") <= k)
        return placed.groupBy(*by).agg(F.sum((F.pow(F.lit(2.0), relevance) - 1) / F.log2(F.col("_k") + 1.0)).alias(name))

    got, best = gains(order, "_dcg"), gains([F.desc(relevance)], "_best")
    joined = got.join(best, list(by)) if by else got.crossJoin(F.broadcast(best))  # one row each
    return joined.select(*by, F.when(F.col("_best") == 0, 0.0).otherwise(F.col("_dcg") / F.col("_best")).alias("ndcg"))


def mean_reciprocal_rank(df: DataFrame, relevance: str, place: str, by: Sequence[str]) -> DataFrame:
    first = df.groupBy(*by).agg(F.min(F.when(F.col(relevance) > 0, F.col(place))).alias("r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"))


def precision_at_k(df: DataFrame, relevance: str, place: str, k: int, by: Sequence[str]) -> DataFrame:
    top = df.where(F.col(place) <= k).groupBy(*by).agg((F.count_if(F.col(relevance) > 0) / float(k)).alias("p"))
    return top.agg(F.avg("p").alias("precision_at_k"))


def accuracy_binary(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.agg(F.avg(((F.col(score) > 0.5).cast("int") == F.col(truth)).cast("double")).alias("accuracy"))
