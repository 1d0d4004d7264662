"""Attention and a small decoder. Attention over table rows is a join and a window; whole sequences run in
NumPy, a sequence a row of an Arrow batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot
from tessera.operators.network import parameters, put_back


def attention(df: DataFrame, by: Sequence[str], place: str, width: int, causal: bool = True, query: str = "q", key: str = "k", value: str = "v") -> DataFrame:
    """(by, place, out): softmax(q k' / sqrt(width)) v within each sequence, by a join on its keys."""
    left = df.select(*by, F.col(place).alias("_i"), F.col(query).alias("_q"))
    right = df.select(*by, F.col(place).alias("_j"), F.col(key).alias("_k"), F.col(value).alias("_v"))
    pairs = left.join(right, list(by))
    pairs = pairs.where("_j <= _i") if causal else pairs
    pairs = pairs.select(*by, "_i", "_j", "_v", (dot(F.col("_q"), F.col("_k")) / float(np.sqrt(width))).alias("_s"))
    row = Window.partitionBy(*by, "_i")
    pairs = pairs.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(row)))
    sums = pairs.groupBy(*by, "_i").agg(F.sum("_e").alias("_t"), *(F.sum(F.col("_e") * F.col("_v")[c]).alias(f"_o{c}") for c in range(width)))
    return sums.select(*by, F.col("_i").alias(place), F.array(*((F.col(f"_o{c}") / F.col("_t")) for c in range(width))).alias("out"))


def embed(df: DataFrame, weights: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, at, vector) of a token array: a join with the table (token, vector)."""
    each = df.select(key, F.posexplode(tokens).alias("at", "token"))
    return each.join(F.broadcast(weights), "token").select(key, "at", "vector")


def layer_norm(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * gamma + beta


def layer_norm_gradient(x: np.ndarray, gamma: np.ndarray, g: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Gradient of the input."""
    sd = np.sqrt(x.var(-1, keepdims=True) + eps)
    n, d = (x - x.mean(-1, keepdims=True)) / sd, g * gamma
    return (d - d.mean(-1, keepdims=True) - n * (d * n).mean(-1, keepdims=True)) / sd


def rotate(x: np.ndarray, places: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """Neighbouring pairs of the last axis turned by place / base^(i/d)."""
    d = x.shape[-1]
    angle = places[:, None] / base ** (np.arange(0, d, 2) / d)
    c, s, a, b = np.cos(angle), np.sin(angle), x[..., 0::2], x[..., 1::2]
    return np.stack([a * c - b * s, a * s + b * c], axis=-1).reshape(x.shape)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Decoder:
    """Pre-norm blocks of attention (rotated before the split into heads) and a gated feed-forward; a
    cache of keys and values makes each generated token one row's work."""

    def __init__(self, vocab: int, width: int, blocks: int, heads: int, hidden: int, longest: int = 512, seed: int = 0) -> None:
        if width % heads:
            raise ValueError("width is not a multiple of heads")
        rng, k = np.random.default_rng(seed), np.sqrt(1 / width)
        make = lambda *shape: rng.uniform(-k, k, shape)
        self.heads, self.width, self.longest = heads, width, longest
        self.params: dict[str, np.ndarray] = {"embed": make(vocab, width), "head": make(vocab, width), "norm.g": np.ones(width), "norm.b": np.zeros(width)}
        self.blocks = blocks
        for n in range(blocks):
            for name, shape in (("q", (width, width)), ("k", (width, width)), ("v", (width, width)), ("o", (width, width)), ("gate", (hidden, width)), ("up", (hidden, width)), ("down", (width, hidden))):
                self.params[f"{n}.{name}"] = make(*shape)
            for name in ("a", "f"):
                self.params |= {f"{n}.{name}.g": np.ones(width), f"{n}.{name}.b": np.zeros(width)}
        self.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, place, value) of all parameters: embedding, blocks, norms and head, of which a part is
        taken by its name's beginning."""
        return parameters(spark, self.params)

    def restore(self, saved: DataFrame, part: str = "") -> Decoder:
        """Parameters of `table` put back, or those of one part; the cache is cleared."""
        put_back({n: a for n, a in self.params.items() if n.startswith(part)}, saved)
        self.clear()
        return self

    def clear(self) -> None:
        self.cache: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, self.width)), np.zeros((0, self.width))) for _ in range(self.blocks)]

    def step(self, tokens: Sequence[int]) -> np.ndarray:
        """Normed hidden states of tokens that follow what the cache holds."""
        p, start = self.params, len(self.cache[0][0])
        if start + len(tokens) > self.longest:
            raise ValueError("sequence is too long")
        x, places = p["embed"][list(tokens)], np.arange(start, start + len(tokens))
        for n in range(self.blocks):
            y = layer_norm(x, p[f"{n}.a.g"], p[f"{n}.a.b"])
            q, k = rotate(y @ p[f"{n}.q"].T, places), rotate(y @ p[f"{n}.k"].T, places)
            keys, values = np.vstack([self.cache[n][0], k]), np.vstack([self.cache[n][1], y @ p[f"{n}.v"].T])
            self.cache[n] = keys, values
            split = lambda m: m.reshape(len(m), self.heads, -1).swapaxes(0, 1)
            s = split(q) @ split(keys).swapaxes(1, 2) / np.sqrt(self.width // self.heads)
            s = np.where(np.arange(len(keys))[None, None] <= places[None, :, None], s, -np.inf)
            x = x + (softmax(s) @ split(values)).swapaxes(0, 1).reshape(len(x), -1) @ p[f"{n}.o"].T
            y = layer_norm(x, p[f"{n}.f.g"], p[f"{n}.f.b"])
            gate = y @ p[f"{n}.gate"].T
            x = x + (gate / (1 + np.exp(-gate)) * (y @ p[f"{n}.up"].T)) @ p[f"{n}.down"].T
        return layer_norm(x, p["norm.g"], p["norm.b"])

    def forward(self, tokens: Sequence[int]) -> np.ndarray:
        self.clear()
        return self.step(tokens)

    def generate(self, prompt: Sequence[int], most: int, temperature: float = 0.0, seed: int = 0) -> list[int]:
        """Tokens after the prompt, until token 0 or `most`."""
        rng, out = np.random.default_rng(seed), []
        hidden = self.forward(prompt)[-1] if len(prompt) else None
        while hidden is not None and len(out) < most:
            z = self.params["head"] @ hidden
            token = int(z.argmax()) if temperature == 0 else int(rng.choice(len(z), p=softmax(z / temperature)))
            out.append(token)
            if token == 0 or len(self.cache[0][0]) >= self.longest:
                break
            hidden = self.step([token])[-1]
        return out


def generate(df: DataFrame, model: Decoder, prompt: str, most: int, temperature: float = 0.0, out: str = "generated") -> DataFrame:
    """Generated tokens of every prompt of a table."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([held.value.generate([int(t) for t in p], most, temperature) for p in prompts], dtype="object")

    return df.withColumn(out, F.pandas_udf(run, "array<int>")(prompt))
