"""Pipelines of preparation steps over named columns, fitted in order and kept as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models, prep


@dataclass
class Pipeline:
    """Steps over `columns`; each may change which columns there are."""

    columns: list[str]
    steps: list[dict] = field(default_factory=list)
    functions: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def add(self, kind: str, **how: object) -> Pipeline:
        """standard, minmax or robust scaling; impute (how='mean' or 'median'); poly (degree); pca (parts)."""
        self.steps.append({"kind": kind, "how": how})
        return self

    def add_custom(self, name: str, fn: Callable[[DataFrame], DataFrame], columns: Sequence[str] | None = None) -> Pipeline:
        """Any frame to frame function; `columns` it leaves, if others."""
        self.functions[name] = fn
        return self.add("custom", name=name, columns=list(columns) if columns else None)

    def fit(self, df: DataFrame) -> Pipeline:
        self.fit_transform(df)
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        columns = list(self.columns)
        for step in self.steps:
            step["columns"] = list(columns)
            kind, how = step["kind"], step["how"]
            if kind in prep.CENTERS:
                step["params"] = {c: list(p) for c, p in prep.Scaler.fit(df, columns, kind).params.items()}
            elif kind == "impute":
                step["params"] = prep.centers(df, columns, how.get("how", "mean"))
            elif kind == "pca":
                fit = models.pca(df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("features")), len(columns), how["parts"])
                step["params"] = {"mean": fit.mean.tolist(), "components": fit.components.tolist()}
            df, columns = self.apply(step, df, columns)
        return df

    def apply(self, step: dict, df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
        kind, how, params = step["kind"], step["how"], step.get("params")
        if kind in prep.CENTERS:
            return prep.Scaler(kind, {c: tuple(p) for c, p in params.items()}).transform(df), columns
        if kind == "impute":
            return df.withColumns({c: F.coalesce(F.col(c), F.lit(params[c])) for c in columns}), columns
        if kind == "poly":
            before = set(df.columns)
            df = prep.polynomial_features(df, columns, how.get("degree", 2), how.get("interaction_only", False))
            return df, columns + [c for c in df.columns if c not in before]
        if kind == "pca":
            fit = models.PCA(np.array(params["mean"]), np.array(params["components"]), np.zeros(0), np.zeros(0), np.zeros(0))
            names = [f"pc{k}" for k in range(len(params["components"]))]
            scores = fit.transform(F.array(*(F.col(f"`{c}`").cast("double") for c in columns)))
            df = df.withColumn("_pc", scores)
            return df.select(*(f"`{c}`" for c in df.columns if c not in columns and c != "_pc"), *(F.col("_pc")[k].alias(n) for k, n in enumerate(names))), names
        if kind == "custom":
            return self.functions[how["name"]](df), how["columns"] or columns
        raise ValueError(kind)

    def transform(self, df: DataFrame) -> DataFrame:
        columns = list(self.columns)
        for step in self.steps:
            df, columns = self.apply(step, df, columns)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """Fitted steps as one JSON line; functions are given again when it is loaded."""
        spark.createDataFrame([(json.dumps({"columns": self.columns, "steps": self.steps}),)], "value string").write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, functions: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Pipeline:
        kept = json.loads(spark.read.text(path).first()[0])
        return cls(kept["columns"], kept["steps"], functions or {})
