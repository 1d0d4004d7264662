"""Language identification by averaged hashed subword embeddings.

A word, framed by '<' and '>', has its character n-grams of two to four; each is hashed to a row of
an embedding table. A text is the average of its subwords' rows; a linear softmax over that average
names the language. Both are trained by stochastic gradient descent in numpy on snippets of a bounded
sample of labelled texts. A temperature, fitted on sample rows kept apart, calibrates the scores; the
lowest score at which the accepted rows kept apart are right 99 times in 100 is the bar for accepting
a prediction.

A prediction reads the whole text and nothing else. As the average is linear, each word's share of
the logits is worked out once a worker and looked up afterwards.

Defined results: a null text, or one without letters, is `und` with score 0 and not accepted. Equal
texts get equal predictions; rows that repeat each give a row, an empty table none; whole texts are read,
however long; ties go to the language that sorts first. With no labelled row every text is `und`; with one language, that one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, crc_of_id, table

#: Bounds of the training sample: documents, snippets of so many words from each.
SAMPLE_ROWS, SNIPPETS = 3000, (4, 12, 40)
BUCKETS, WIDTH, NGRAMS, EPOCHS, BATCH, RATE = 1 << 16, 12, (2, 3, 4), 4, 32, 0.5
MEMO = 150_000
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def subwords(word: str) -> list[int]:
    framed = f"<{word}>"
    return [zlib.crc32(framed[k : k + n].encode()) % BUCKETS for n in NGRAMS for k in range(len(framed) - n + 1)]


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass
class LanguageModel:
    """`table`: logits of each subword row (bucket x language); the rest calibrates."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bar: float = 0.0

    def logits(self, total: np.ndarray, n: float) -> np.ndarray:
        return (total / max(1.0, n) + self.bias) / self.temperature


class Reader:
    """Scores whole texts, remembering words; one a task."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.memo = model, {}
        self.rows = np.zeros((MEMO, len(model.langs) + 1))

    def learn(self, words: set[str]) -> None:
        """Logit sums and subword counts of those of the words that were not met before."""
        fresh = list(words.difference(self.memo))
        if not fresh:
            return
        if len(self.memo) + len(fresh) > len(self.rows):
            self.memo.clear()
            fresh = list(words)
            if len(fresh) > len(self.rows):
                self.rows = np.zeros((len(fresh), self.rows.shape[1]))
        ids = [subwords(w) for w in fresh]
        sizes = np.array([len(i) for i in ids])
        flat = np.fromiter((i for row in ids for i in row), dtype=np.int64, count=int(sizes.sum()))
        at = len(self.memo)
        self.rows[at : at + len(fresh), :-1] = np.add.reduceat(self.model.table[flat], np.cumsum([0, *sizes[:-1]]), axis=0)
        self.rows[at : at + len(fresh), -1] = sizes
        self.memo.update(zip(fresh, range(at, at + len(fresh))))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, and whether it clears the bar."""
        words, m = words_of(text), self.model
        if not words or not m.langs:
            return UND, 0.0, False
        self.learn(set(words))
        total = self.rows[np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        z = m.logits(total[:-1], total[-1])
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return m.langs[best], float(p[best]), bool(p[best] >= m.bar)


def train(snippets: list[tuple[str, str]], apart: list[bool], seed: int = 7) -> LanguageModel:
    """Embeddings and softmax from (snippet, language) rows; rows `apart` only calibrate."""
    langs = sorted({lang for _, lang in snippets})
    rng = np.random.default_rng(seed)
    rows = []
    for text, lang in snippets:
        ids = [i for w in words_of(text) for i in subwords(w)]
        rows.append((np.array(ids, dtype=np.int64), langs.index(lang)))
    use = [r for r, a in zip(rows, apart) if len(r[0]) and not a]
    held = [r for r, a in zip(rows, apart) if len(r[0]) and a] or use
    if not use or len(langs) < 2:
        return LanguageModel(langs, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)))
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((len(langs), WIDTH)), np.zeros(len(langs))
    steps, done = EPOCHS * (len(use) // BATCH + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(use))
        for at in range(0, len(order), BATCH):
            part = [use[k] for k in order[at : at + BATCH]]
            rate = RATE * (1 - done / steps)
            done += 1
            flat = np.concatenate([i for i, _ in part])
            sizes = np.array([len(i) for i, _ in part])
            mean = np.add.reduceat(emb[flat], np.cumsum([0, *sizes[:-1]]), axis=0) / sizes[:, None]
            z = mean @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [t for _, t in part]] -= 1
            back = p @ out
            out -= rate * p.T @ mean
            bias -= rate * 0.1 * p.sum(axis=0) / len(part)
            np.add.at(emb, flat, np.repeat(-rate * back / sizes[:, None] * 4, sizes, axis=0))
    model = LanguageModel(langs, emb @ out.T, bias)
    z = np.array([model.table[i].sum(axis=0) / len(i) + bias for i, _ in held])
    truth = np.array([t for _, t in held])
    return calibrate(model, z, truth)


def calibrate(model: LanguageModel, z: np.ndarray, truth: np.ndarray, precision: float = 0.99) -> LanguageModel:
    """Temperature of least log loss, then the lowest bar with the precision."""

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    ladder = np.geomspace(0.05, 20, 60)
    loss = [-np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in ladder]
    model.temperature = float(ladder[int(np.argmin(loss))])
    p = probabilities(model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.bar = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def fit_on(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Model from a bounded sample of the training folds; executors cut the snippets."""
    base = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % 4 != 2))
    picked = bounded_sample(base.select("doc_id"), "doc_id", rows, "langid").dropDuplicates(["doc_id"])
    sample = base.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def snip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for i, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
                words = words_of(text)
                for k, n in enumerate(SNIPPETS):
                    at = zlib.crc32(f"{i}/{k}".encode()) % max(1, len(words) - n + 1)
                    made.append((i, k, " ".join(words[at : at + n]), lang))
            if made:
                yield pd.DataFrame(made, columns=["doc_id", "k", "snippet", "lang"])

    got = sample.mapInPandas(snip, "doc_id bigint, k int, snippet string, lang string").orderBy("doc_id", "k").collect()
    apart = [zlib.crc32(f"apart{r.doc_id}".encode()) % 5 == 0 for r in got]
    return train([(r.snippet, r.lang) for r in got], apart)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """`df` with the struct `out`, in place of a column of that name: lang, score, accepted."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(held.value)
        for texts in batches:
            got = [reader.predict(t) for t in texts]
            yield pd.DataFrame({"lang": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[2] for g in got]})

    return df.withColumn(out, F.pandas_udf(run, "struct<lang:string,score:double,accepted:boolean>")(F.col(text)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_on(docs)
    found = identify(docs.select("doc_id", "text"), model, out="found")
    return found.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.accepted").alias("accepted"))
