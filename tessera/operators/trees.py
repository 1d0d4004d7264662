"""Regression trees on gradients and boosting. A level of a tree is one aggregate over binned features
for all its nodes; trees are compiled to nested conditions, so scoring stays in generated code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def best_split(df: DataFrame, columns: Sequence[str], grad: str, hess: str, penalty: float = 1.0, gamma: float = 0.0) -> DataFrame:
    """Exact best split of one node: feature, threshold (midway, lower goes left) and gain. Equal values
    are summed before they are ordered, so a window holds distinct values only."""
    tall = df.select(F.col(grad).alias("g"), F.col(hess).alias("h"), *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["g", "h"], list(columns), "feature", "x")
    sums = tall.groupBy("feature", "x").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    w = Window.partitionBy("feature").orderBy("x")
    every = Window.partitionBy("feature")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.select("feature", "x", F.lead("x").over(w).alias("nx"), F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(every).alias("ga"), F.sum("h").over(every).alias("ha"))
    part = lambda g, h: g * g / (h + penalty)
    gl, hl, ga, ha = (F.col(c) for c in ("gl", "hl", "ga", "ha"))
    gain = part(gl, hl) + part(ga - gl, ha - hl) - part(ga, ha) - gamma
    found = rows.where("nx is not null").select("feature", ((F.col("x") + F.col("nx")) / 2).alias("threshold"), gain.alias("gain"))
    return found.orderBy(F.desc("gain"), "feature", "threshold").limit(1)


@dataclass
class Node:
    """A leaf has no feature."""

    value: float
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) <= self.threshold, self.left.column()).otherwise(self.right.column())

    def rows(self, at: int = 1) -> list[tuple]:
        """(node, feature, threshold, value) rows; children of k are 2k and 2k + 1."""
        own = [(at, self.feature, float(self.threshold), float(self.value))]
        return own + (self.left.rows(2 * at) + self.right.rows(2 * at + 1) if self.feature is not None else [])


def from_rows(rows: Sequence[tuple], at: int = 1) -> Node:
    """The tree of rows as `Node.rows` gives them."""
    by = {r[0]: r for r in rows}

    def made(k: int) -> Node:
        _, feature, threshold, value = by[k]
        return Node(value) if feature is None else Node(value, feature, threshold, made(2 * k), made(2 * k + 1))

    return made(at)


def fit_tree(df: DataFrame, columns: Sequence[str], grad: str, hess: str, edges: dict[str, Sequence[float]], depth: int = 3, penalty: float = 1.0, gamma: float = 0.0) -> Node:
    """Histogram tree: each level sums gradients by (node, feature, bin) of all its nodes at once."""
    binned = {c: sum(((F.col(c) > float(e)).cast("int") for e in edges[c]), F.lit(0)) for c in columns}
    rows = df.select(F.col(grad).alias("_g"), F.col(hess).alias("_h"), *columns, *(b.alias(f"_b_{c}") for c, b in binned.items()))
    total = rows.agg(F.sum("_g"), F.sum("_h")).first()
    root = Node(-(total[0] or 0.0) / ((total[1] or 0.0) + penalty))
    level = {1: root}
    where = F.lit(1)
    for _ in range(depth):
        tall = rows.select(where.alias("node"), "_g", "_h", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"_b_{c}").alias("b")) for c in columns))).alias("f"))
        sums = tall.where(F.col("node").isin(*level)).groupBy("node", "f.c", "f.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        grown: dict[int, Node] = {}
        for k, node in level.items():
            best = (0.0, None, 0, 0.0, 0.0, 0.0, 0.0)
            for c in columns:
                cells = sorted((r["b"], r["g"], r["h"]) for r in sums if r["node"] == k and r["c"] == c)
                ga, ha = sum(x[1] for x in cells), sum(x[2] for x in cells)
                gl = hl = 0.0
                for b, g, h in cells[:-1]:
                    gl, hl = gl + g, hl + h
                    gain = gl * gl / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga * ga / (ha + penalty) - gamma
                    if gain > best[0] + 1e-12:
                        best = (gain, c, b, gl, hl, ga - gl, ha - hl)
            if best[1] is not None:
                node.feature, node.threshold = best[1], float(edges[best[1]][best[2]])
                node.left, node.right = Node(-best[3] / (best[4] + penalty)), Node(-best[5] / (best[6] + penalty))
                grown |= {2 * k: node.left, 2 * k + 1: node.right}
        if not grown:
            break
        paths = F.when(F.lit(False), 0)
        for k, node in level.items():
            if node.feature is not None:
                paths = paths.when(where == k, F.when(F.col(node.feature) <= node.threshold, 2 * k).otherwise(2 * k + 1))
        where, level = paths.otherwise(0), grown
    return root


@dataclass
class Boosted:
    """Sum of trees over a base score."""

    base: float = 0.5
    rate: float = 0.1
    trees: list[Node] = field(default_factory=list)

    def raw(self) -> Column:
        return sum((t.column() * self.rate for t in self.trees), F.lit(self.base))

    def rows(self) -> list[tuple]:
        return [(k, *r) for k, t in enumerate(self.trees) for r in t.rows()]

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, value) of all trees; tree -1 holds base and rate."""
        return spark.createDataFrame([(-1, 0, None, float(self.rate), float(self.base)), *self.rows()], "tree int, node int, feature string, threshold double, value double")


def load_boosted(saved: DataFrame) -> Boosted:
    """The ensemble of a `Boosted.table`."""
    by: dict[int, list[tuple]] = {}
    for r in saved.orderBy("tree", "node").toLocalIterator():
        by.setdefault(r["tree"], []).append(tuple(r)[1:])
    _, _, rate, base = by.pop(-1)[0]
    return Boosted(base, rate, [from_rows(rows) for _, rows in sorted(by.items())])


LOSSES: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "mse": lambda y, f: (2 * (f - y), F.lit(2.0)),
    "bce": lambda y, f: (1 / (1 + F.exp(-f)) - y, F.greatest(1 / (1 + F.exp(-f)) * (1 - 1 / (1 + F.exp(-f))), F.lit(1e-6))),
}


def boost(df: DataFrame, columns: Sequence[str], target: str, rounds: int = 10, rate: float = 0.1, depth: int = 3, loss: str | Callable = "mse", bins: int = 32, penalty: float = 1.0, gamma: float = 0.0) -> Boosted:
    """Gradient boosting on quantile bins; `loss` names one or gives (gradient, hessian) columns."""
    fn = LOSSES[loss] if isinstance(loss, str) else loss
    cuts = df.agg(*(F.percentile_approx(F.col(c).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(c) for c in columns)).first()
    edges = {c: sorted(set(cuts[c] or [])) for c in columns}
    model = Boosted(rate=rate)
    for _ in range(rounds):
        g, h = fn(F.col(target).cast("double"), model.raw())
        model.trees.append(fit_tree(df.withColumns({"_grad": g, "_hess": h}), columns, "_grad", "_hess", edges, depth, penalty, gamma))
    return model
