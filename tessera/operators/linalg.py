"""Small dense algebra at the driver, and large products as joins of cells (i, j, v)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def cells(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, v) of rows of vectors."""
    return df.select(F.col(key).alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of cell frames: one join on the inner index, sums combined before the second shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of cells times a vector of (j, v)."""
    return a.join(x.select("j", F.col("v").alias("y")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def random_normal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.randn(seed) * std + mean).alias("x"))


def random_uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.rand(seed) * (high - low) + low).alias("x"))


def solve(a: Matrix, b: Sequence[float]) -> np.ndarray:
    """Least squares where the matrix is singular."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def inverse(a: Matrix) -> np.ndarray:
    return np.linalg.inv(np.asarray(a, dtype=float))


def determinant(a: Matrix) -> float:
    return float(np.linalg.det(np.asarray(a, dtype=float)))


def eigen(a: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, eigenvectors by column, of a symmetric matrix."""
    values, vectors = np.linalg.eigh(np.asarray(a, dtype=float))
    return values[::-1], vectors[:, ::-1]


def lu(a: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with P a = L U, by outer products."""
    u = np.array(a, dtype=float)
    n = len(u)
    p, low = np.eye(n), np.zeros((n, n))
    for k in range(n):
        top = k + int(np.abs(u[k:, k]).argmax())
        for m in (u, p, low):
            m[[k, top]] = m[[top, k]]
        low[k, k] = 1.0
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return p, low, np.triu(u)


def svd(a: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(np.asarray(a, dtype=float), full_matrices=False)
    return u, s, vt.T
