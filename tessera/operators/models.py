"""Classical models. Sums over rows are distributed aggregates; what is solved at the driver is as
small as the number of features, classes or clusters. Rows hold a vector `features array<double>`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import EPS
from tessera.functions.vectors import dot, euclidean, literal
from tessera.operators import blocks as blocked
from tessera.operators.frame import positions

BLOCK = 2048


def moments(df: DataFrame, columns: Sequence[str | Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sums and the matrix of sums of products, in one aggregate."""
    cols = [F.col(c).cast("double") if isinstance(c, str) else c for c in columns]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    one = df.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0.0)) for c in cols), *(F.coalesce(F.sum(cols[i] * cols[j]), F.lit(0.0)) for i, j in pairs)).first()
    m = np.zeros((k, k))
    for (i, j), v in zip(pairs, one[1 + k :]):
        m[i, j] = m[j, i] = v
    return float(one[0]), np.array(one[1 : 1 + k], dtype=float), m


@dataclass
class LinearFit:
    """Weights (intercept first) and the fit's summary; r2 and the rest are exact from the sums."""

    names: list[str]
    weights: np.ndarray
    std_errors: np.ndarray
    r2: float
    adjusted_r2: float
    aic: float
    bic: float
    f_statistic: float
    n: int

    def predict(self) -> Column:
        return sum((F.col(c).cast("double") * float(w) for c, w in zip(self.names, self.weights[1:])), F.lit(float(self.weights[0])))

    def summary(self) -> str:
        rows = [f"{n:>16} {w: .6f} ({s:.6f})" for n, w, s in zip(["intercept", *self.names], self.weights, self.std_errors)]
        return "\n".join([*rows, f"r2={self.r2:.6f} adjusted={self.adjusted_r2:.6f} f={self.f_statistic:.4f} aic={self.aic:.2f} bic={self.bic:.2f} n={self.n}"])


def ols(df: DataFrame, columns: Sequence[str], target: str, ridge: float = 0.0) -> LinearFit:
    """Least squares by the normal equations, with an intercept; `ridge` is an L2 weight on the rest."""
    n, sums, products = moments(df, [*columns, target])
    k = len(columns)
    a = np.zeros((k + 1, k + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = n, sums[:k], sums[:k], products[:k, :k]
    b = np.array([sums[k], *products[:k, k]])
    inverse = np.linalg.pinv(a + ridge * np.diag([0.0] + [1.0] * k))
    w = inverse @ b
    sse = max(0.0, float(products[k, k] - 2 * w @ b + w @ a @ w))
    sst = float(products[k, k] - sums[k] ** 2 / max(n, 1))
    r2 = 1 - sse / sst if sst > 0 else 0.0
    free = max(1.0, n - k - 1)
    errors = np.sqrt(np.maximum(0, np.diag(inverse)) * sse / free)
    log = n * np.log(max(sse / max(n, 1), 1e-300))
    f = (r2 / max(k, 1)) / ((1 - r2) / free + EPS)
    return LinearFit(list(columns), w, errors, r2, 1 - (1 - r2) * (n - 1) / free, float(log + 2 * (k + 1)), float(log + np.log(max(n, 1)) * (k + 1)), f, int(n))


def elastic_net(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 0.1, l1_ratio: float = 0.5):  # noqa: ANN201
    """L1 and L2 by the ml library; ridge is l1_ratio 0, lasso 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=list(columns), outputCol="_f").transform(df)
    return LinearRegression(featuresCol="_f", labelCol=target, regParam=alpha, elasticNetParam=l1_ratio).fit(rows)


def logistic_regression(df: DataFrame, columns: Sequence[str], target: str, rate: float = 0.1, steps: int = 100, l2: float = 0.0) -> np.ndarray:
    """Weights (intercept first) by full-batch gradient steps; a step is one aggregate."""
    n = max(1, df.count())
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    w = np.zeros(len(x))
    for _ in range(steps):
        err = probability(columns, w) - F.col(target)
        g = np.array(df.agg(*(F.sum(err * c) for c in x)).first(), dtype=float) / n
        w -= rate * (g + l2 * np.append(0.0, w[1:]))
    return w


def probability(columns: Sequence[str], w: Sequence[float]) -> Column:
    z = sum((F.col(c).cast("double") * float(v) for c, v in zip(columns, w[1:])), F.lit(float(w[0])))
    return 1 / (1 + F.exp(-z))


def nearest(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, k: int, metric: str = "euclidean", blocks: int = 16) -> DataFrame:
    """The k nearest base rows of each query, ties by base_id, with the base's other columns; a distance to or from
    a null, or between unequal lengths, is null and comes last.

    A task compares one block of queries with one of base rows, of at most BLOCK and 16 BLOCK rows, as matrices, and
    returns k rows a query. A stated query set meets all rows."""
    asks, held = (max(1, -(-df.count() // rows)) for df, rows in ((queries, BLOCK), (base, 16 * BLOCK)))
    held = max(held, -(-blocks // asks))
    rest = [f"{base_id}", *(c for c in base.columns if c not in (base_id, "features"))]
    q = queries.select(F.col(query_id).alias("_q"), F.col("features").alias("_f"), blocked.block(query_id, asks).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(held - 1))).alias("_j"))
    b = base.select(*rest, F.col("features").alias("_f"), blocked.block(base_id, held).alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("_i"))
    both = q.withColumn("_asks", F.lit(True)).unionByName(b.withColumn("_asks", F.lit(False)), allowMissingColumns=True)

    def best(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asking, base_ = rows.filter(rows["_asks"]), rows.filter(pa.compute.invert(rows["_asks"])).sort_by(base_id)
        if not len(asking) or not len(base_):
            return
        (x, x_good), (y, y_good) = blocked.matrix(asking["_f"]), blocked.matrix(base_["_f"])
        if x.shape[1] != y.shape[1]:
            x, x_good = x[:0], np.zeros(len(asking), dtype=bool)
        xs, ys = np.flatnonzero(x_good), np.flatnonzero(y_good)
        i, j, d = blocked.nearest(x, y, k, metric) if len(xs) and len(ys) else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
        i, j = xs[i], ys[j]
        lack = [(r, c) for r in range(len(asking)) for c in (np.flatnonzero(~y_good)[: max(0, k - len(ys))] if x_good[r] else range(min(k, len(base_))))] if not x_good.all() or len(ys) < k else []
        i, j = (np.r_[a, np.array([p[n] for p in lack], dtype=int)] for n, a in enumerate((i, j)))
        distance = pa.concat_arrays([pa.array(d), pa.nulls(len(lack), pa.float64())])
        took = base_.select(rest).take(pa.array(j))
        out = pa.table([asking["_q"].take(pa.array(i)), *took.columns, distance], names=[query_id, *rest, "distance"])
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    kinds = dict(base.dtypes)
    schema = ", ".join([f"`{query_id}` {dict(queries.dtypes)[query_id]}", *(f"`{c}` {kinds[c]}" for c in rest), "distance double"])
    found = blocked.met(both, F.col("_i") * held + F.col("_j"), asks * held, best, schema)
    w = Window.partitionBy(query_id).orderBy(F.col("distance").asc_nulls_last(), base_id)
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn_class(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, label: str, k: int = 5) -> DataFrame:
    """Majority of the k nearest; a tied vote goes to the smallest label."""
    votes = nearest(queries.select(query_id, "features"), base.select(base_id, "features", label), query_id, base_id, k).groupBy(query_id, label).agg(F.count("*").alias("_n"))
    return votes.groupBy(query_id).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("predicted"))


def knn_regress(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, target: str, k: int = 5) -> DataFrame:
    found = nearest(queries.select(query_id, "features"), base.select(base_id, "features", target), query_id, base_id, k)
    return found.groupBy(query_id).agg(F.avg(target).alias("predicted"))


def pairwise(df: DataFrame, key: str, metric: str = "euclidean", blocks: int = 8) -> DataFrame:
    """Distances of all pairs, the smaller key first. Quadratic by definition; a task takes two blocks of at most
    BLOCK rows as matrices and returns their pairs a few rows at a time."""
    blocks = max(blocks, -(-df.count() // BLOCK))
    rows = df.select(F.col(key).alias("a"), F.col("features").alias("_f"), blocked.block(key, blocks).alias("_x"))
    kind = dict(df.dtypes)[key]

    def paired(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("a")
        (f, good), at = blocked.matrix(rows["_f"]), rows["_x"].to_numpy()
        keys, place = rows["a"].combine_chunks(), np.cumsum(good) - 1
        number = pa.compute.rank(keys, tiebreaker="dense").to_numpy().astype(int) if len(keys) else np.zeros(0, dtype=int)
        left, right = (np.flatnonzero(at == x) for x in blocked.sides(rows))
        for start in range(0, len(left), step := max(1, blocked.CELLS // max(1, len(right)))):
            part = left[start : start + step]
            d = np.full((len(part), len(right)), np.nan)
            fine = np.ix_(good[part], good[right])
            whole = list(blocked.table(f[place[part[good[part]]]], f[place[right[good[right]]]], metric))
            if whole:
                d[fine] = np.vstack([x for _, x in whole])
            less = number[part][:, None] < number[right][None]
            if len(right) and at[part[0]] != at[right[0]]:
                less |= number[part][:, None] > number[right][None]
            i, j = np.nonzero(less)
            p, q = part[i], right[j]
            first = number[p] < number[q]
            values = pa.array(d[i, j], mask=~(good[p] & good[q]))
            yield pa.record_batch([keys.take(pa.array(np.where(first, p, q))), keys.take(pa.array(np.where(first, q, p))), values], names=["a", "b", "distance"])

    return blocked.half(rows.where(F.col("a").isNotNull()), blocks, paired, f"a {kind}, b {kind}, distance double")


def gaussian_nb_fit(df: DataFrame, label: str, width: int) -> DataFrame:
    """label, log prior, means and variances (+1e-9) by class, in one aggregate."""
    n = df.count()
    v = lambda j: F.col("features")[j]
    means = F.array(*(F.avg(v(j)) for j in range(width)))
    spreads = F.array(*((F.var_pop(v(j)) + 1e-9) for j in range(width)))
    return df.groupBy(label).agg(F.log(F.count("*") / float(max(1, n))).alias("prior"), means.alias("means"), spreads.alias("vars"))


def gaussian_nb_predict(df: DataFrame, model: DataFrame, key: str, label: str) -> DataFrame:
    """key, predicted label and its posterior; the model has one row a class."""
    like = F.aggregate(
        F.zip_with(F.arrays_zip(F.col("means").alias("m"), F.col("vars").alias("v")), "features", lambda p, x: -(F.log(p["v"] * 6.2832) + (x - p["m"]) * (x - p["m"]) / p["v"]) / 2),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    classes = F.broadcast(model.select(F.col(label).alias("_c"), "prior", "means", "vars"))
    scored = df.select(key, "features").join(classes).select(key, "_c", (F.col("prior") + like).alias("_l"))  # classes only
    best = scored.groupBy(key).agg(F.max_by("_c", F.struct("_l", -F.col("_c"))).alias("predicted"), F.max("_l").alias("_m"), F.collect_list("_l").alias("_all"))
    rest = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m")))
    return best.select(key, "predicted", (1 / rest).alias("posterior"))


@dataclass
class KMeans:
    """Centres, inertia by iteration."""

    centers: np.ndarray
    inertia: list[float] = field(default_factory=list)

    def assign(self, features: Column) -> Column:
        """Index of the nearest centre, ties to the lowest."""
        parts = [F.struct(squared(features, literal(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(self.centers)]
        return F.array_min(F.array(*parts))["k"]


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kmeans_seed(df: DataFrame, key: str, k: int, seed: int = 42, sample: int = 5000) -> np.ndarray:
    """k-means++ over a bounded sample, the same rows at any partitioning."""
    rng = np.random.default_rng(seed)
    rows = df.select("features", key).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample).collect()
    x = np.array([r["features"] for r in rows], dtype=float)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centers)


def kmeans_step(df: DataFrame, model: KMeans) -> DataFrame:
    """Cluster, count, mean of each place and sum of squared distances: one Lloyd step."""
    width = model.centers.shape[1]
    rows = df.withColumn("cluster", model.assign(F.col("features")))
    own = F.array(*(literal(c) for c in model.centers))
    rows = rows.withColumn("_d", squared(F.col("features"), F.element_at(own, F.col("cluster") + 1)))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("features")[j]) for j in range(width))).alias("center"), F.sum("_d").alias("inertia"))


def kmeans(df: DataFrame, key: str, k: int, steps: int = 100, seed: int = 42, starts: int = 1, tolerance: float = 1e-6) -> KMeans:
    """Lloyd from k-means++ starts; an empty cluster keeps its centre; the start of least inertia wins."""
    best: KMeans | None = None
    for s in range(starts):
        m = KMeans(kmeans_seed(df, key, k, seed + s))
        for _ in range(steps):
            rows = kmeans_step(df, m).collect()
            new = m.centers.copy()
            for r in rows:
                new[r["cluster"]] = r["center"]
            m.inertia.append(float(sum(r["inertia"] for r in rows)))
            moved = float(np.abs(new - m.centers).max())
            m.centers = new
            if moved < tolerance:
                break
        if best is None or m.inertia[-1] < best.inertia[-1]:
            best = m
    return best


def elbow(df: DataFrame, key: str, most: int, seed: int = 42) -> list[float]:
    return [kmeans(df, key, k, seed=seed, starts=3).inertia[-1] for k in range(1, most + 1)]


def silhouette(df: DataFrame, key: str, label: str, block_rows: int = 16384) -> DataFrame:
    """Mean silhouette. Rows are dealt to blocks of about `block_rows`, fewer where labels are many; a task takes two
    blocks, works out their distances as matrices, a few rows at a time, and returns sums by (row, other label);
    pairs never leave it. Quadratic by definition; what is sent grows with rows times blocks."""
    n, labels = df.agg(F.count("*"), F.approx_count_distinct(label)).first()
    most = max(1, min(block_rows, max(1024, block_rows * 64 // max(1, labels))))
    blocks = max(1, -(-n // most), min(8, n // 512))
    rows = df.select(F.col(key).alias("a"), F.col(label).alias("own"), F.col("features").alias("x"), blocked.block(key, blocks).alias("_x"))
    names = ["a", "own", "other", "total", "n"]

    def summed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([("_x", "ascending"), ("own", "ascending")])
        at, x = rows["_x"].to_numpy(), blocked.matrix(rows["x"])[0]
        keys, own = rows["a"].combine_chunks(), rows["own"].combine_chunks()
        code, name = own.dictionary_encode("encode").indices.to_numpy(), pa.compute.rank(keys, tiebreaker="dense").to_numpy()
        sides = [np.flatnonzero(at == v) for v in blocked.sides(rows)]
        if not all(map(len, sides)):
            return
        starts = [np.flatnonzero(np.r_[True, code[s][1:] != code[s][:-1]]) for s in sides]
        here, there = (np.zeros((len(sides[p]), len(starts[1 - p]))) for p in (0, 1))
        counts = [np.tile(np.diff(np.r_[starts[1 - p], len(sides[1 - p])]), (len(sides[p]), 1)) for p in (0, 1)]
        same = len(np.unique(at)) == 1
        group = np.repeat(np.arange(len(starts[0])), np.diff(np.r_[starts[0], len(sides[0])]))
        for first, d in blocked.distances(x[sides[0]], x[sides[1]]):
            part = np.arange(first, first + len(d))
            if same:
                i, j = np.nonzero(name[sides[0][part]][:, None] == name[sides[1]][None])
                d[i, j] = 0.0
                np.subtract.at(counts[0], (part[i], group[j]), 1)
            here[part] = np.add.reduceat(d, starts[1], axis=1)
            if not same:
                cuts = np.flatnonzero(np.r_[True, group[part][1:] != group[part][:-1]])
                there[:, group[part[cuts]]] += np.add.reduceat(d, cuts, axis=0).T
        for p, totals in enumerate((here,) if same else (here, there)):
            for some in np.array_split(np.arange(len(totals)), -(-totals.size // 100_000)):
                each, other = np.repeat(sides[p][some], totals.shape[1]), np.tile(sides[1 - p][starts[1 - p]], len(some))
                yield pa.record_batch([keys.take(pa.array(each)), own.take(pa.array(each)), own.take(pa.array(other)), pa.array(totals[some].ravel()), pa.array(counts[p][some].ravel())], names=names)

    kinds = dict(rows.dtypes)
    sums = blocked.half(rows, blocks, summed, f"a {kinds['a']}, own {kinds['own']}, other {kinds['own']}, total double, n bigint")
    means = sums.groupBy("a", "own", "other").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    each = means.groupBy("a").agg(F.coalesce(F.max(F.when(F.col("own") == F.col("other"), F.col("m"))), F.lit(0.0)).alias("near"), F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("far"))
    return each.agg(F.avg((F.col("far") - F.col("near")) / (F.greatest("near", "far") + EPS)).alias("silhouette"))


def centroids(df: DataFrame, label: str, width: int) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("features")[j]) for j in range(width))).alias("center"))


def davies_bouldin(df: DataFrame, label: str, width: int) -> float:
    """From centres and mean distances to them; only classes reach the driver."""
    c = centroids(df, label, width)
    rows = df.join(F.broadcast(c), label).groupBy(label).agg(F.avg(euclidean(F.col("features"), F.col("center"))).alias("s"), F.first("center").alias("c")).collect()
    parts = [max(((a["s"] + b["s"]) / (np.linalg.norm(np.subtract(a["c"], b["c"])) + EPS) for b in rows if b is not a), default=0.0) for a in rows]
    return float(np.mean(parts)) if parts else 0.0


def calinski_harabasz(df: DataFrame, label: str, width: int) -> float:
    c = centroids(df, label, width)
    within = df.join(F.broadcast(c), label).agg(F.sum(squared(F.col("features"), F.col("center")))).first()[0]
    rows = c.collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    mean = sum(np.array(r["center"]) * r["n"] for r in rows) / n
    between = sum(r["n"] * float(((np.array(r["center"]) - mean) ** 2).sum()) for r in rows)
    return float(between / (k - 1) / (within / (n - k) + EPS))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of undirected edges (a, b): every node takes the least label around it, and the label
    of its label, until nothing changes. Each round is checkpointed."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("_m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "_m").alias("new"), "root")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("_j"))
        nxt = step.join(jump, "new", "left").select("node", F.coalesce("_j", "new").alias("new"), "root")
        nxt = checkpointed(nxt)
        changed = nxt.where("new <> root").take(1)
        labels = nxt.select("node", F.col("new").alias("root"))
        if not changed:
            break
    return labels


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that the cluster names; a local one only where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def dbscan(df: DataFrame, key: str, eps: float, least: int, cells: Sequence[int] | None = None) -> DataFrame:
    """key and cluster (by the lowest core key, from 0; noise -1).

    Copies of a vector are one weighted row. Rows are dealt by a grid over some places of the vector (the most spread
    ones, as many as give the tasks few rows each, or `cells`), and stand in every cell within eps of them, so a pair
    within eps is never missed. A task finds the neighbours of the rows of its cells as matrices; it returns how many
    they are, then one link a row to the others of its cluster in that task, and so pairs never leave it."""
    one = df.select(F.col(key), F.col("features")).where(F.col("features").isNotNull())
    copies = checkpointed(one.groupBy("features").agg(F.min(key).alias("id"), F.count("*").alias("w")))
    n, width = copies.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    place = lambda j: F.get("features", F.lit(j))
    spread = copies.agg(F.lit(0.0), *(F.stddev_pop(place(j)) for j in range(width))).first()[1:]
    parts = max(copies.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK // 4))
    grid, bits = {}, 0.0
    for j in sorted(range(width) if cells is None else cells, key=lambda j: -(spread[j] or 0.0)):
        side = max(1.6 * (spread[j] or 0.0), 2.5 * eps)
        gain, cost = np.log2(max(1e-9, 4.13 * (spread[j] or 0.0) / side)), np.log2(1 + 2 * eps / side)
        if np.isfinite(gain) and gain > cost and bits < np.log2(8 * parts):
            grid[j], bits = side, bits + gain - cost
    around, home = F.array(F.array(F.size("features").cast("bigint"))), [F.size("features").cast("bigint")]
    reach = eps * (1 + 1e-9)
    for j, side in grid.items():
        cell = lambda v, side=side: F.coalesce(F.floor(v / side), F.lit(0)).cast("bigint")
        near = F.array_distinct(F.array(cell(place(j)), cell(place(j) - reach), cell(place(j) + reach)))
        around = F.flatten(F.transform(around, crossed(near)))
        home.append(cell(place(j)))

    def dealt(rows: DataFrame) -> DataFrame:
        sent = rows.withColumns({"_at": F.explode(around), "_own": F.array(*home)})
        task = F.pmod(F.xxhash64("_at"), F.lit(parts))
        return sent.select("id", "w", "features", *(c for c in rows.columns if c == "core"), (F.col("_at") == F.col("_own")).alias("home"), task.alias("task"))

    def rows_of(rows: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Table]]:
        """Of each length of vectors: ids, vectors, which rows are at home; a row of several cells once."""
        sizes = pa.compute.list_value_length(rows["features"])
        for size in sizes.unique().to_pylist():
            some = rows.filter(pa.compute.equal(sizes, size)).sort_by([("id", "ascending"), ("home", "descending")])
            code = pa.compute.rank(some["id"].combine_chunks(), tiebreaker="dense").to_numpy()
            some = some.take(pa.array(np.flatnonzero(np.r_[True, code[1:] != code[:-1]])))
            x, good = blocked.matrix(some["features"])
            good[good] = np.isfinite(x).all(1)
            x = x[np.isfinite(x).all(1)]
            some = some.filter(pa.array(good))
            if size and len(some):
                yield some["id"].combine_chunks(), x, some["home"].to_numpy(), some

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for ids, x, own, some in rows_of(rows):
            w, total = some["w"].to_numpy(), np.zeros(len(x))
            for i, j in blocked.within(x, np.flatnonzero(own), eps):
                total += np.bincount(i, weights=w[j], minlength=len(x))
            yield pa.record_batch([ids.filter(pa.array(own)), pa.array(total[own] >= least)], names=["id", "core"])

    def linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for ids, x, own, some in rows_of(rows):
            core, border = some["core"].to_numpy(), []

            def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in blocked.within(x, np.flatnonzero(own), eps):
                    border.append((i[~core[i] & core[j]], j[~core[i] & core[j]]))
                    yield i[core[i] & core[j]], j[core[i] & core[j]]

            root = blocked.joined(len(x), links())
            a, b = (np.concatenate([p[k] for p in border] or [np.zeros(0, dtype=int)]) for k in (0, 1))
            fringe = np.unique(np.c_[a, root[b]], axis=0)
            mine = np.flatnonzero(core)
            a, b = np.r_[mine, fringe[:, 0]], np.r_[root[mine], fringe[:, 1]]
            yield pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(np.arange(len(a)) < len(mine))], names=["a", "b", "inner"])

    kind = dict(df.dtypes)[key]
    core = blocked.met(dealt(copies), F.col("task"), parts, counted, f"id {kind}, core boolean")
    flagged = copies.join(core, "id")
    close = checkpointed(blocked.met(dealt(flagged), F.col("task"), parts, linked, f"a {kind}, b {kind}, inner boolean"))
    roots = components(close.where("inner"))
    named = roots.join(positions(roots.select("root").distinct(), ["root"], "cluster"), "root").select("node", F.col("cluster").cast("int").alias("cluster"))
    fringe = close.where(~F.col("inner")).join(named, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("cluster"))
    placed = named.select(F.col("node").alias("id"), "cluster").unionByName(fringe.withColumnRenamed("a", "id"))
    held = one.join(copies.join(placed, "id").select("features", "cluster"), "features").select(key, "cluster")
    return df.select(key).join(held, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def crossed(values: Column):  # noqa: ANN201
    return lambda c: F.transform(values, lambda o: F.concat(c, F.array(o)))


@dataclass
class PCA:
    """Mean, components by row, variance explained and its ratio, singular values."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    singular: np.ndarray

    def transform(self, features: Column) -> Column:
        centred = F.zip_with(features, literal(self.mean), lambda x, m: x - m)
        return F.array(*(dot(centred, literal(c)) for c in self.components))

    def inverse(self, scores: Column) -> Column:
        back = [dot(scores, literal(self.components[:, j])) + float(self.mean[j]) for j in range(len(self.mean))]
        return F.array(*back)


def pca(df: DataFrame, width: int, parts: int) -> PCA:
    """Covariance in one aggregate, eigenvectors at the driver; the largest weight of each is positive."""
    n, sums, products = moments(df, [F.col("features")[j].cast("double") for j in range(width)])
    mean = sums / max(n, 1)
    cov = (products - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:parts]
    c = vectors[:, order].T
    c *= np.sign(c[np.arange(len(c)), np.abs(c).argmax(axis=1)])[:, None]
    lam = np.maximum(values[order], 0)
    return PCA(mean, c, lam, lam / max(values.sum(), EPS), np.sqrt(lam * max(n - 1, 1)))


def agglomerative(points: Sequence[Sequence[float]], linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) of a bounded set of points; new clusters are numbered on."""
    x = np.asarray(points, dtype=float)
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    size, name, alive, merges = np.ones(n), list(range(n)), np.ones(n, dtype=bool), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        merges.append((min(name[i], name[j]), max(name[i], name[j]), float(d[i, j]), int(size[i] + size[j])))
        row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])}[linkage]
        alive[j] = False
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return merges


def cut_dendrogram(merges: Sequence[tuple[int, int, float, int]], n: int, clusters: int) -> list[int]:
    """Labels from 0 in order of first point."""
    parent = list(range(n + len(merges)))
    for k, (a, b, _, _) in enumerate(merges[: n - clusters]):
        parent[a] = parent[b] = n + k

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    return [seen.setdefault(top(i), len(seen)) for i in range(n)]


def tsne(points: Sequence[Sequence[float]], perplexity: float = 20.0, steps: int = 300, rate: float = 100.0, seed: int = 0) -> np.ndarray:
    """Two-dimensional embedding of a bounded set of points, by the exact gradient."""
    x = np.asarray(points, dtype=float)
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.zeros((n, n))
    goal = np.log(min(perplexity, max(2, n - 1) / 1.5))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(d[i] - np.delete(d[i], i).min()) * beta)
            e[i] = 0
            q = e / e.sum()
            h = -np.sum(q[q > 0] * np.log(q[q > 0]))
            low, high = (beta, high) if h > goal else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-2, (n, 2))
    v = np.zeros_like(y)
    for t in range(steps):
        k = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(k, 0)
        g = ((p * (4 if t < 100 else 1) - k / k.sum()) * k)[:, :, None] * (y[:, None] - y[None])
        v = (0.5 if t < 100 else 0.8) * v - rate * 4 * g.sum(1)
        y = y + v - (y + v).mean(0)
    return y


def by_key(df: DataFrame, key: str, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """A NumPy routine of this package over the bounded rows of each key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf)

    return df.groupBy(key).applyInPandas(run, schema)
