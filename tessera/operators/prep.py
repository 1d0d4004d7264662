"""Preparation: scalers, encoders, bins, imputation, outliers, resampling, splits, feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS, scaled, unscaled
from tessera.operators.frame import positions
from tessera.operators.quantiles import quantiles
from tessera.operators.stats import binned, pearson

CENTERS = {"standard": F.avg, "minmax": F.min, "robust": F.median}
SPREADS = {
    "standard": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    "minmax": lambda c: F.max(c) - F.min(c),
}


@dataclass
class Scaler:
    """Centre and spread by column, fitted in one pass, or a few for quartiles; they are scalars in the plan afterwards."""

    kind: str
    params: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], kind: str = "standard") -> Scaler:
        if kind == "robust":
            held = quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
            return cls(kind, {c: (q2 or 0.0, (q3 - q1) if q2 is not None else 0.0) for c, (q1, q2, q3) in held.items()})
        one = df.agg(*(f[kind](F.col(c)).cast("double").alias(f"{c}|{k}") for c in columns for k, f in enumerate((CENTERS, SPREADS)))).first()
        return cls(kind, {c: (one[f"{c}|0"] or 0.0, one[f"{c}|1"] or 0.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: scaled(F.col(c), F.lit(m), F.lit(s)) for c, (m, s) in self.params.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: unscaled(F.col(c), F.lit(m), F.lit(s)) for c, (m, s) in self.params.items()})


def centers(df: DataFrame, columns: Sequence[str], how: str) -> dict[str, float | None]:
    """Mean or exact median of each column."""
    if how == "median":
        return {c: held[0] for c, held in quantiles(df, {c: F.col(c) for c in columns}, (0.5,)).items()}
    return df.agg(*({"mean": F.avg}[how](c).alias(c) for c in columns)).first().asDict()


def impute(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Nulls become the column's mean or exact median."""
    one = centers(df, columns, how)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(one[c])) for c in columns})


def impute_knn(df: DataFrame, column: str, features: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Nulls become the mean of the k rows nearest by the features that have the value."""
    vec = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    have = df.where(F.col(column).isNotNull()).select(vec.alias("features"), F.col(column).cast("double").alias("_y"), F.col(key).alias("_k"))
    lack = df.where(F.col(column).isNull()).select(F.col(key), vec.alias("features"))
    from tessera.operators.models import nearest

    found = nearest(lack, have, key, "_k", k).groupBy(key).agg(F.avg("_y").alias("_fill"))
    return df.join(found, key, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("_fill"))).drop("_fill")


def label_ids(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """(value, id) by first appearance, the state of a label encoder."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("_f"))
    return positions(firsts, ["_f"], "_id").select("value", F.col("_id").cast("int").alias("id"))


def transform_labels(df: DataFrame, column: str, ids: DataFrame, out: str = "label") -> DataFrame:
    """Ids of a column; unseen values and null are -1."""
    return df.join(ids.select(F.col("value").alias(column), F.col("id").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def inverse_labels(df: DataFrame, label: str, ids: DataFrame, out: str = "value") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(label), F.col("value").alias(out)), label, "left")


def target_encode(df: DataFrame, category: str, target: str, smoothing: float = 1.0, out: str = "encoded") -> DataFrame:
    """(n m_c + s m) / (n + s) by category."""
    parts = df.groupBy(category).agg(F.sum(target).alias("_t"), F.count(target).alias("_n"))
    whole = df.agg(F.avg(target)).first()[0]
    enc = parts.select(category, ((F.col("_t") + smoothing * F.lit(whole)) / (F.col("_n") + smoothing)).alias(out))
    return df.join(enc, category, "left")


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """The columns, then products of pairs (with squares unless interaction_only), then cubes from degree 3."""
    out = list(df.columns)
    new: dict[str, Column] = {}
    if degree >= 2:
        new |= {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for j, b in enumerate(columns) if j > i or j == i and not interaction_only}
    if degree >= 3:
        new |= {f"{a}^3": F.col(a) * F.col(a) * F.col(a) for a in columns}
    return df.select(*out, *(e.alias(n) for n, e in new.items()))


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})


def equal_width_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(out, binned(F.col(column), F.lit(low), F.lit(high), bins))


def equal_frequency_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """By the exact quantiles of the column; equal values share a bin."""
    edges = [q for q in quantiles(df, {column: F.col(column)}, [k / bins for k in range(1, bins)])[column] if q is not None]
    return custom_bins(df, column, edges, out)


def custom_bins(df: DataFrame, column: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Number of edges at or below the value."""
    return df.withColumn(out, F.when(F.col(column).isNotNull(), sum(((F.col(column) >= float(e)).cast("int") for e in edges), F.lit(0))))


def z_score_outliers(df: DataFrame, column: str, threshold: float = 3.0, out: str = "outlier") -> DataFrame:
    mean, std = df.agg(F.avg(column), F.coalesce(F.stddev_samp(column), F.lit(0.0))).first()
    return df.withColumn(out, F.abs(scaled(F.col(column), F.lit(mean), F.lit(std))) > threshold)


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5, out: str = "outlier") -> DataFrame:
    q1, q3 = quantiles(df, {column: F.col(column)}, (0.25, 0.75))[column]
    reach = multiplier * (q3 - q1) if q1 is not None else 0.0
    return df.withColumn(out, (F.col(column) < F.lit(q1) - reach) | (F.col(column) > F.lit(q3) + reach))


def isolation_forest(df: DataFrame, columns: Sequence[str], key: str, trees: int = 50, sample: int = 256, seed: int = 0, out: str = "anomaly") -> DataFrame:
    """Anomaly score in (0, 1): trees grown on bounded samples at the driver, rows scored in batches."""
    rng = np.random.default_rng(seed)
    rows = df.select(key, *(F.col(c).cast("double") for c in columns)).orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(sample * 8).toPandas()
    data = rows[list(columns)].fillna(0.0).to_numpy()
    deep = int(np.ceil(np.log2(max(2, min(sample, len(data))))))

    def expected(n: int) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(x: np.ndarray, depth: int) -> tuple:
        if depth >= deep or len(x) <= 1 or (x.max(0) == x.min(0)).all():
            return (depth + expected(len(x)),)
        j = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
        at = rng.uniform(x[:, j].min(), x[:, j].max())
        return int(j), float(at), grow(x[x[:, j] < at], depth + 1), grow(x[x[:, j] >= at], depth + 1)

    forest = [grow(data[rng.permutation(len(data))[:sample]], 0) for _ in range(trees)] if len(data) else []
    usual = max(expected(min(sample, len(data))), 1e-9)

    def depth(x: np.ndarray, node: tuple, rows_: np.ndarray, into: np.ndarray) -> None:
        if len(node) == 1:
            into[rows_] += node[0]
            return
        left = x[rows_, node[0]] < node[1]
        depth(x, node[2], rows_[left], into)
        depth(x, node[3], rows_[~left], into)

    def run(*cols: pd.Series) -> pd.Series:
        x, got = np.column_stack([c.fillna(0.0) for c in cols]), np.zeros(len(cols[0]))
        for t in forest:
            depth(x, t, np.arange(len(x)), got)
        return pd.Series(2.0 ** (-got / max(1, len(forest)) / usual))

    return df.withColumn(out, F.pandas_udf(run, "double")(*(F.col(c).cast("double") for c in columns)))


def shuffled(seed: int, key: str) -> Column:
    """An order that a seed settles, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def train_test_split(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """`is_test` marks the last floor(n ratio) rows of the shuffled (or key) order, exactly."""
    from tessera.operators.frame import positions

    n = df.count()
    placed = positions(df.withColumn("_o", shuffled(seed, key) if shuffle else F.col(key)), ["_o", key], "_p")
    return placed.withColumn("is_test", F.col("_p") >= n - int(n * ratio)).drop("_o", "_p")


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The same share of each class is test."""
    w = Window.partitionBy(label)
    placed = df.withColumn("_k", F.row_number().over(w.orderBy(shuffled(seed, key), key))).withColumn("_n", F.count("*").over(w))
    return placed.withColumn("is_test", F.col("_k") > F.col("_n") - F.floor(F.col("_n") * ratio)).drop("_k", "_n")


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """`fold` of each row; folds hold floor(n/k) rows, the last the rest."""
    from tessera.operators.frame import positions

    size = max(1, df.count() // k)
    placed = positions(df.withColumn("_o", shuffled(seed, key) if shuffle else F.col(key)), ["_o", key], "_p")
    return placed.withColumn("fold", F.least(F.floor(F.col("_p") / size), F.lit(k - 1)).cast("int")).drop("_o", "_p")


def stratified_k_fold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(label).orderBy(shuffled(seed, key), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def group_k_fold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Groups are numbered, not their rows; a group lies in one fold."""
    ids = df.select(group).distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(group)) - 1) % k).cast("int"))
    return df.join(ids, group, "left")


def time_series_split(df: DataFrame, order: Sequence[str], splits: int = 5, gap: int = 0) -> DataFrame:
    """(split, row) memberships of expanding windows: role 'train' or 'val'."""
    from tessera.operators.frame import positions

    size = df.count() // (splits + 1)
    placed = positions(df, order, "_p").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    end = (F.col("split") + 1) * size
    role = F.when(F.col("_p") < end, "train").when((F.col("_p") >= end + gap) & (F.col("_p") < end + gap + size), "val")
    return placed.withColumn("role", role).where(F.col("role").isNotNull()).drop("_p")


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """One fold a row: (fold, is_test) are expressions of the key, no table of pairs is made."""
    return df.withColumn("fold", F.col(key))


def random_oversample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Rows of smaller classes repeat evenly until each class has the largest's count."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    most = max(counts.values(), default=0)
    w = Window.partitionBy(label).orderBy(key)
    times = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, n)))
    n = F.element_at(times, F.col(label))
    copies = F.floor(F.lit(most) / n) + (F.row_number().over(w) <= F.lit(most) % n).cast("int")
    return df.withColumn("_c", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_c") - 1).cast("int")))).drop("_c")


def random_undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Of each class as many rows as the smallest has."""
    least = min((r[1] for r in df.groupBy(label).count().collect()), default=0)
    w = Window.partitionBy(label).orderBy(shuffled(seed, key), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= least).drop("_k")


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The smallest class grows to the largest's count by points between a row and one of its k nearest
    of that class."""
    from tessera.operators.models import checkpointed, nearest

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(False))
    small, need = min(counts, key=lambda c: (counts[c], str(c))), max(counts.values()) - min(counts.values())
    few = df.where(F.col(label) == F.lit(small)).select(F.col(key), F.array(*(F.col(f).cast("double") for f in features)).alias("features"))
    pairs = nearest(few, few.select(F.col(key).alias("_k"), "features", F.col("features").alias("_to")), key, "_k", k + 1).where(F.col(key) != F.col("_k"))
    by = Window.partitionBy(key).orderBy("distance", "_k")
    near = checkpointed(pairs.withColumn("_r", F.row_number().over(by)).join(few, key))  # at most k + 1 rows a key, read several times
    each = -(-need // max(1, counts[small]))
    made = near.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).where((F.xxhash64(F.lit(seed), F.col(key), F.col("_c")) % k + k) % k + 1 == F.col("_r"))
    lam = F.abs(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("_c")) % 1_000_000) / 1e6
    made = positions(made, ["_c", key], "_p").where(F.col("_p") < need)
    points = made.select(*((F.col("features")[j] + lam * (F.col("_to")[j] - F.col("features")[j])).alias(f) for j, f in enumerate(features)), F.lit(small).alias(label), F.lit(True).alias("synthetic"))
    own = df.select(*(F.col(f).cast("double").alias(f) for f in features), label, F.lit(False).alias("synthetic"))
    return own.unionByName(points)


def variance_threshold(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    one = df.agg(*(F.coalesce(F.var_samp(c), F.lit(0.0)).alias(c) for c in columns)).first()
    return [c for c in columns if one[c] > threshold]


def remove_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """From left to right, a column goes if its |r| with a kept one passes the threshold; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs)).first() if pairs else {}
    kept: list[str] = []
    for b in columns:
        if all(abs(one[f"{a}|{b}"]) <= threshold for a in kept):
            kept.append(b)
    return kept


def f_classif(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """ANOVA F of each feature, all in one aggregate by class."""
    g = df.groupBy(label).agg(F.count("*").cast("double").alias("_n"), *(f(F.col(c)).alias(f"{k}|{c}") for c in columns for k, f in (("m", F.avg), ("v", F.var_pop))))
    n = F.col("_n")
    m, v = (lambda c: F.col(f"`m|{c}`")), (lambda c: F.col(f"`v|{c}`"))
    between = lambda c: (F.sum(n * m(c) * m(c)) - F.pow(F.sum(n * m(c)), F.lit(2.0)) / F.sum(n)) / (F.count("*") - 1)
    within = lambda c: F.sum(n * v(c)) / (F.sum(n) - F.count("*"))
    one = g.agg(*((between(c) / (within(c) + EPS)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "feature", "score")


def f_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """r^2 / (1 - r^2) (n - 2) of each feature."""
    r2 = lambda c: F.pow(pearson(F.col(c), F.col(target)), F.lit(2.0))
    one = df.agg(*((r2(c) / (1 - r2(c) + EPS) * (F.count("*") - 2)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "feature", "score")


def mutual_info_classif(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    from functools import reduce

    from tessera.operators.stats import mutual_information

    rows = [mutual_information(df, c, label, bins, bin_y=False).select(F.lit(c).alias("feature"), F.col("mutual_information").alias("score")) for c in columns]
    return reduce(DataFrame.unionAll, rows)


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "feature").limit(k)


