"""Toxicity by weak supervision.

Many voters (lexicons of words, of word beginnings and of repeated ones, and surface patterns) vote
toxic, clean or abstain on each document. A generative label model estimates, without looking at one
label, each voter's accuracy in either class and, in every round, the correlations between voters given the
class; correlated voters share one voice. Its posterior labels train a linear classifier over term
features, which scores whole texts.

A term is a word or a word beginning, or either of them standing REPEATED times or more; so words that are
made up as they go, but begin alike, are found in any language by few documents.

Rows of the training sample come only from `labels` and only from documents whose
crc32(doc_id) mod 5 is not 0. Labels serve to mine the lexicons and to name the classes; source,
lang and doc_id are never inputs of a score.

Defined results: a null text counts as empty; an empty text gets the classifier's score of a text
without any term. Whole texts are read, however long. Documents keep one output row for each input row, copies get equal scores;
an empty table gives none; ties among mined terms go by the term.
Without any usable label the mined lexicons are empty and the seed lexicons alone vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, crc_of_id, cut, fresh, table

#: Training rows read by the driver: labelled documents and their texts' terms. Documented bounds.
SAMPLE_ROWS = 6000
#: Terms of the classifier at most.
FEATURES = 4096
#: A mined term's least toxic texts and log odds.
SUPPORT, ODDS = 3, 2.5
VOTERS = 24
PREFIXES = (3, 4, 5, 6)
#: A term's occurrences from which it counts as repeated, and the mark of that.
REPEATED, AGAIN = 3, "#"
WORD = re.compile(r"[^\W\d_]+")

#: Seed lexicon: common English words of insult.
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")


def beginnings(word: str) -> list[str]:
    """The word and its beginnings, these marked by '*'."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def terms(text: str) -> set[str]:
    """Distinct terms of a text: words in lower case, word beginnings, and which of them are repeated."""
    counts: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        for t in beginnings(w):
            counts[t] += n
    return {*counts, *(t + AGAIN for t, n in counts.items() if n >= REPEATED)}


PATTERNS = (
    re.compile(r"\byou(?:'re| are)? (?:an? )?\w+\b", re.I),
    re.compile(r"\b(?:shut up|go away|get lost|hate you|kill you)\b", re.I),
    re.compile(r"!{3,}"),
    re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){3,}"),
)


@dataclass
class ToxicModel:
    """Weights by term, bias; `voters`, `accuracy` and `groups` tell what the label model found."""

    weights: dict[str, float]
    bias: float
    voters: list[list[str]] = field(default_factory=list)
    accuracy: np.ndarray | None = None
    correlation: np.ndarray | None = None

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]] | None = None) -> float:
        """Probability that a whole text is toxic. `memo` remembers the weighted terms of words."""
        weights, memo, hit = self.weights, {} if memo is None else memo, {}
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            found = memo.get(w)
            if found is None:
                if len(memo) > 200_000:
                    memo.clear()
                found = memo[w] = tuple(t for t in beginnings(w) if t in weights or t + AGAIN in weights)
            for t in found:
                hit[t] = hit.get(t, 0) + n
        z = self.bias + sum(weights.get(t, 0.0) + (weights.get(t + AGAIN, 0.0) if hit[t] >= REPEATED else 0.0) for t in sorted(hit))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def tally(texts: list[str], toxic: list[int]) -> tuple[Counter, Counter]:
    """In how many toxic and clean texts each term stands; clean counts only of terms met in toxic ones."""
    in_toxic, in_clean = Counter(), Counter()
    for text, t in zip(texts, toxic):
        (in_toxic if t else in_clean).update(terms(text))
    return in_toxic, in_clean


def mine(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int, size: int = FEATURES) -> list[str]:
    """Terms that mark toxic documents, by log odds with smoothing and a support of SUPPORT at least, of one
    less if repeated; strongest by (log odds x log support). counts: (term, toxic texts, clean texts)."""
    scored = []
    for t, a, c in counts:
        if a >= SUPPORT - t.endswith(AGAIN):
            odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
            if odds > ODDS:
                scored.append((-odds * math.log(1 + a), t))
    return [t for _, t in sorted(scored)[:size]]


def read(text: str, vocabulary: frozenset[str]) -> tuple[list[str], list[int]]:
    """What training needs of a text: its terms of the vocabulary, and the patterns' votes."""
    return sorted(terms(text) & vocabulary), [1 if p.search(text) else 0 for p in PATTERNS]


def vote(docs: list[set[str]], patterns: np.ndarray, lexicons: list[list[str]]) -> np.ndarray:
    """Matrix of votes: 1 toxic, -1 clean, 0 abstains. A lexicon votes toxic on a hit and clean on a
    miss; a pattern votes toxic on a hit and abstains on a miss."""
    sets = [set(x) for x in lexicons]
    lex = np.array([[1 if s & d else -1 for s in sets] for d in docs], dtype=np.int8).reshape(len(docs), len(sets))
    return np.hstack([lex, patterns.astype(np.int8)])


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by document, P(vote | class) by voter, correlations between voters given
    the class. Expectation-maximisation over a naive-Bayes model whose voters are weighted by
    1 / sqrt(sum of |residual correlation| with the others), the effective number of a clique."""
    n, m = votes.shape
    if not n or not m:
        return np.full(n, prior), np.zeros((2, m, 3)), np.eye(m)
    q = np.clip((votes == 1).mean(axis=1) * 1.5, 0.02, 0.98)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    weight, corr = np.ones(m), np.eye(m)
    table_ = np.zeros((2, m, 3))
    for _ in range(rounds):
        for c, mass in ((0, 1 - q), (1, q)):
            table_[c] = (np.einsum("n,nmv->mv", mass, hot) + 0.5) / (mass.sum() + 1.5)
        # residual correlations: what the class does not explain, less what chance would show
        mean = np.array([-1.0, 0.0, 1.0])
        left = votes - (q[:, None] * (table_[1] @ mean) + (1 - q[:, None]) * (table_[0] @ mean))
        sd = np.sqrt((left**2).mean(axis=0)) + 1e-6
        corr = np.clip(left.T @ left / n / np.outer(sd, sd), -1, 1)
        weight = 1 / np.sqrt(1 + (np.maximum(np.abs(corr) - 2 / math.sqrt(n), 0) * (1 - np.eye(m))).sum(axis=1))
        share = min(0.5, max(0.5 * prior, float(q.mean())))
        z = math.log(share / (1 - share)) + np.einsum("nmv,mv,m->n", hot, np.log(table_[1]) - np.log(table_[0]), weight)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, table_, corr


def linear(docs: list[set[str]], target: np.ndarray, vocabulary: list[str], epochs: int = 60, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on term presence: full-batch gradient steps with momentum
    (Adam), the classes weighted to equal mass."""
    index = {t: i for i, t in enumerate(vocabulary)}
    rows = [[index[t] for t in sorted(d & index.keys())] for d in docs]
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([x for row in rows for x in row], dtype=np.int64)
    w, b = np.zeros(len(vocabulary) + 1), 0.0
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    mass1 = max(1e-6, float(target.sum()))
    mass0 = max(1e-6, float(len(target) - target.sum()))
    each = target * (0.5 / mass1) + (1 - target) * (0.5 / mass0)
    for step in range(1, 10 * epochs + 1):
        z = np.bincount(r, weights=w[c], minlength=len(rows)) + w[-1]
        err = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.append(np.bincount(c, weights=err[r], minlength=len(vocabulary)) + l2 * w[:-1], err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    b = float(w[-1])
    return w[:-1], b


def fit_read(hits: list[set[str]], patterns: np.ndarray, mined: list[str], prior: float) -> ToxicModel:
    """Lexicons from the mined terms, label model, linear classifier on its posterior labels."""
    lexicons = [[s] for s in SEED] + [x for i in range(VOTERS) if (x := mined[i::VOTERS])]
    posterior, tables, corr = label_model(vote(hits, patterns, lexicons), max(0.01, min(0.5, prior)))
    vocabulary = list(dict.fromkeys([*SEED, *mined]))
    if len(hits) and (posterior >= 0.5).any():
        weights, bias = linear(hits, posterior, vocabulary)
    else:
        weights, bias = np.array([4.0 if t in SEED else 0.0 for t in vocabulary]), -2.0
    return ToxicModel(dict(zip(vocabulary, map(float, weights))), bias, lexicons, tables, corr)


def fit(texts: list[str], toxic: list[int]) -> ToxicModel:
    """The whole method on texts in memory."""
    in_toxic, in_clean = tally(texts, toxic)
    n = sum(map(bool, toxic))
    mined = mine([(t, a, in_clean[t]) for t, a in in_toxic.items()], n, len(texts) - n)
    rows = [read(t, frozenset([*SEED, *mined])) for t in texts]
    return fit_read([set(h) for h, _ in rows], as_votes([p for _, p in rows]), mined, n / max(1, len(texts)))


def as_votes(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, dtype=np.int8).reshape(len(rows), len(PATTERNS))


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Model from at most `rows` labelled documents of the training folds. Executors count terms and
    read texts; the driver gets the mined terms and, a document, those of them that it has."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("mark"))
    marked = bounded_sample(marked.where(crc_of_id() % 5 != 0), "doc_id", rows, "toxicity").dropDuplicates(["doc_id"])
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    sample = cut(sample.dropDuplicates(["doc_id"]).select("doc_id", "text", "mark"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                both = tally(list(part["text"]), list(part["mark"]))
                for m, c in ((m, c) for m, c in zip((1, 0), both) if c):
                    yield pd.DataFrame({"term": list(c), "n1": [n * m for n in c.values()], "n0": [n * (1 - m) for n in c.values()]})

    sizes = {r["mark"]: r["count"] for r in sample.groupBy("mark").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    a, c = F.sum("n1"), F.sum("n0")
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    strong = sample.select("text", "mark").mapInPandas(counted, "term string, n1 bigint, n0 bigint").groupBy("term").agg(a.alias("a"), c.alias("c"))
    strong = strong.where((F.col("a") >= SUPPORT - F.col("term").endswith(AGAIN).cast("int")) & (odds > ODDS)).orderBy((-odds * F.log(F.col("a") + 1)), "term").limit(FEATURES)
    mined = mine([tuple(r) for r in strong.collect()], n1, n0)
    known = frozenset([*SEED, *mined])

    def reads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read(t, known) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "hits": [h for h, _ in got], "patterns": [p for _, p in got]})

    got = sample.mapInPandas(reads, "doc_id bigint, hits array<string>, patterns array<int>").orderBy("doc_id").collect()
    return fit_read([set(r.hits) for r in got], as_votes([r.patterns for r in got]), mined, n1 / max(1, n1 + n0))


def score(docs: DataFrame, model: ToxicModel, out: str = "score") -> DataFrame:
    """`docs` with the score column `out`, in place of one of that name; every other column passes as it is."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine_, memo = held.value, {}
        for texts in batches:
            yield pd.Series([mine_.score(t, memo) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (crc_of_id() % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored 0.5 or more go."""
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxic_score")
    return score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)
