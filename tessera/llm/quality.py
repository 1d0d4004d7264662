"""Quality classifier by co-training.

Two linear classifiers see two views of a document that share no input: its text content (character
classes, word shapes, repetition, line layout) and its page metadata (source, language, size). Both start
from the labelled rows. Then, for some rounds, each names the documents it is sure of, surest first, and
those pseudo-labels go into the *other* one's training set, in the proportions of the labelled classes and
with no more weight together than the labelled rows have. Sure is what a view's score says once it is
calibrated on labelled rows that neither view was trained on, so a view that has learned nothing names
nothing. A logistic combination of the views, fitted on the same rows, scores every whole document.

Pseudo-labels are sought among all documents. A round is STEPS Newton steps; for a step executors sum
gradients and curvatures of the named documents, of which only the sums reach the driver. The labelled
sample is bounded (LABELLED rows, lowest by a salted hash of doc_id). Defined results: null text counts
as empty, null source or lang as a value of their own; whole texts are read, however long; rows that repeat
score alike if their metadata do, an empty table gives none; ties in the sample go by doc_id; without
labels of both classes every document scores 1 and is kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, cut, fresh, table

#: Bound of the labelled sample; how sure a view must be to name a document, by round; steps of a round.
LABELLED, SURE, STEPS, L2 = 5000, (0.99, 0.97, 0.95, 0.92, 0.9), 2, 1e-3
SOURCES, LANGS = 32, 8
SYMBOLS = "#$%&*|~^<>{}[]\\=+_@"
RUN = re.compile(r"[^\w\s]{2,}")
UPPER = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")


def content_view(text: str) -> list[float]:
    """Features of the whole text: characters, words, repetition, lines."""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(1 for _ in UPPER.finditer(text))
    runs = sum(1 for _ in RUN.finditer(text))
    again = sum(map(eq, words, islice(words, 1, None)))
    pairs = max(1, m - 1)
    skip = sum(map(eq, words, islice(words, 2, None)))
    bang, pipe, digits = text.count("!"), text.count("|"), sum(map(text.count, "0123456789"))
    distinct = len(set(words)) / m
    ends = text.count(".") / m
    counts = (symbols, upper, runs, again, bang, pipe, digits)
    rates = (symbols / n, upper / m, runs / m, again / pairs, bang / m, pipe / m, digits / n)
    lines = text.split("\n")
    k, different, sizes = len(lines), len(set(lines)), list(map(len, lines))
    layout = (math.log1p(sum(sizes) / k), math.log1p(max(sizes)), 1 - different / k, math.log1p(k - different), sum(s < 20 for s in sizes) / k, sum(not s for s in sizes) / k)
    return [*map(math.sqrt, rates), *map(math.log1p, counts), math.sqrt(skip / pairs), distinct, distinct * math.log1p(m), ends, len(text) / m / 10, *layout]


def metadata_view(size: int, source: str | None, lang: str | None) -> list[float]:
    """Features of where the page came from and how large it is."""
    held = [0.0] * (SOURCES + LANGS)
    held[zlib.crc32(("s" + source).encode()) % SOURCES if source is not None else 0] = 1.0
    held[SOURCES + (zlib.crc32(("l" + lang).encode()) % LANGS if lang is not None else 0)] = 1.0
    return [math.log1p(size), math.log1p(size) ** 2 / 10, *held]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Linear classifier over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def slopes(self, x: np.ndarray, t: np.ndarray | float) -> np.ndarray:
        """Sums over rows with target t: their number, gradient and curvature, in one vector."""
        a = np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])
        p = sigmoid(a @ np.append(self.weights, self.bias))
        return np.concatenate([[len(x)], a.T @ (p - t), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])

    def stepped(self, sums: np.ndarray) -> Logistic:
        """A Newton step down the mean loss that the sums describe."""
        d = len(self.weights) + 1
        w, keep = np.append(self.weights, self.bias), np.append(np.full(d - 1, L2), 0)
        g = sums[1 : d + 1] / sums[0] + keep * w
        h = sums[d + 1 :].reshape(d, d) / sums[0] + np.diag(keep + 1e-6)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
        return Logistic(self.mean, self.scale, w[:-1], float(w[-1]))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = L2) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    a = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    w, m1, m2 = np.zeros(a.shape[1]), np.zeros(a.shape[1]), np.zeros(a.shape[1])
    keep = np.append(np.full(x.shape[1], l2), 0)
    for t in range(1, steps + 1):
        g = a.T @ (sigmoid(a @ w) - y) / len(y) + keep * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class CoTrained:
    """Both views, and the calibrated combination of their logits."""

    content: Logistic
    metadata: Logistic
    blend: Logistic
    platt: list[Logistic]

    def score(self, xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
        """Columns: calibrated content view, calibrated metadata view, combined."""
        za, zb = self.content.logit(xa)[:, None], self.metadata.logit(xb)[:, None]
        return np.column_stack([sigmoid(self.platt[0].logit(za)), sigmoid(self.platt[1].logit(zb)), sigmoid(self.blend.logit(np.hstack([za, zb])))])


#: The two views' classifiers, and the calibrations of their logits.
Pair = tuple[list[Logistic], list[Logistic]]


def named_sums(pair: Pair, sure: float, views: list[np.ndarray]) -> np.ndarray:
    """For each view and class, the sums over the documents that the other view names."""
    models, platt = pair
    z = [c.logit(m.logit(x)[:, None]) for m, c, x in zip(models, platt, views)]
    bar, out = math.log(sure / (1 - sure)), []
    for i in (0, 1):
        other = z[1 - i]
        out += [models[i].slopes(views[i][rows], float(c)) for c, rows in ((0, other <= -bar), (1, other >= bar))]
    return np.concatenate(out)


def co_train(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, pool: Callable[[Pair, float], np.ndarray]) -> CoTrained | None:
    """The exchange of pseudo-labels; pool(pair, sure) gives named_sums over all documents. Every fourth
    labelled row is kept apart for calibration."""
    if len(np.unique(y)) < 2 or len(y) < 8:
        return None
    apart = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[apart])) < 2 or len(np.unique(y[~apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    held = apart if apart.any() else ~apart
    own = [x[~apart] for x in (xa, xb)]
    t, truth = y[~apart].astype(float), y[held].astype(float)
    share = (1 - float(t.mean()), float(t.mean()))
    models = [logistic(x, t) for x in own]
    sizes = [1 + d + d * d for d in (x.shape[1] + 1 for x in own)]
    seen = lambda: [m.logit(x[held])[:, None] for m, x in zip(models, (xa, xb))]
    for sure in SURE:
        for _ in range(STEPS):
            platt = [logistic(z, truth) for z in seen()]
            parts = np.split(pool((models, platt), sure), np.cumsum([sizes[0], sizes[0], sizes[1]]))
            moved = []
            for i, m in enumerate(models):
                sums, named = m.slopes(own[i], t), parts[2 * i : 2 * i + 2]
                mass = min(len(t), *(p[0] / s for p, s in zip(named, share)))
                for p, s in zip(named, share):
                    sums = sums + p * (mass * s / max(1.0, p[0]))
                moved.append(m.stepped(sums))
            models = moved
    za, zb = seen()
    return CoTrained(models[0], models[1], logistic(np.hstack([za, zb]), truth), [logistic(za, truth), logistic(zb, truth)])


def in_memory(ua: np.ndarray, ub: np.ndarray) -> Callable[[Pair, float], np.ndarray]:
    """The pool of documents whose views are given."""
    return lambda pair, sure: named_sums(pair, sure, [ua, ub])


def in_table(features: DataFrame) -> Callable[[Pair, float], np.ndarray]:
    """The pool of all documents, from a written table of their views a and b."""

    def pool(pair: Pair, sure: float) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: np.ndarray | float = 0.0
            for batch in batches:
                if len(batch):
                    total = total + named_sums(pair, sure, [np.stack(batch[c].to_list()).astype(float) for c in ("a", "b")])
            if isinstance(total, np.ndarray):
                yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

        empty = named_sums(pair, sure, [np.zeros((0, len(m.mean))) for m in pair[0]])
        for r in features.mapInPandas(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            empty[r["k"]] = r["v"]
        return empty

    return pool


def both_views(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, sources, langs in batches:
        rows = [(content_view(t or ""), metadata_view(len(t or ""), s, g)) for t, s, g in zip(texts, sources, langs)]
        yield pd.DataFrame(rows, columns=["a", "b"])


def fit_on(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained | None:
    """Model from a bounded labelled sample and all documents; only the sample's features and sums over
    the rest reach the driver."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality_label"))
    marked = bounded_sample(marked, "doc_id", labelled, "quality").dropDuplicates(["doc_id"])
    seen = F.pandas_udf(both_views, "struct<a:array<float>,b:array<float>>")("text", "source", "lang").alias("views")
    features = cut(docs.select("doc_id", seen).select("doc_id", "views.a", "views.b"))
    known = features.join(F.broadcast(marked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not known:
        return None
    a, b = (np.array([r[c] for r in known], dtype=float) for c in ("a", "b"))
    return co_train(a, b, np.array([r.quality_label for r in known]), in_table(features.select("a", "b")))


def score(docs: DataFrame, model: CoTrained | None, out: str = "quality") -> DataFrame:
    """`docs` with the struct column `out`, in place of one of that name: content, metadata, combined (probabilities of class 1)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<content:double,metadata:double,combined:double>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["content", "metadata", "combined"]
        for texts, sources, langs in batches:
            if held.value is None or not len(texts):
                yield pd.DataFrame(np.ones((len(texts), 3)), columns=names)
                continue
            a = np.array([content_view(t or "") for t in texts])
            b = np.array([metadata_view(len(t or ""), s, g) for t, s, g in zip(texts, sources, langs)])
            yield pd.DataFrame(held.value.score(a, b), columns=names)

    return docs.withColumn(out, scored("text", "source", "lang"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    q = score(docs.select("doc_id", "text", "source", "lang"), model)
    return q.select(
        "doc_id",
        F.col("quality.content").alias("content_score"),
        F.col("quality.metadata").alias("metadata_score"),
        F.col("quality.combined").alias("score"),
        (F.col("quality.combined") >= 0.5).alias("keep"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose combined score is under 0.5 go."""
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality_scores")
    return score(docs, model, name).where(F.col(f"{name}.combined") >= 0.5).select(*docs.columns)
