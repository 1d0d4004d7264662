"""Small neural networks in NumPy: layers with forward and backward passes, training at the driver on a
bounded sample, scoring of whole tables in Arrow batches, parameters as a Parquet table.

Backward passes take the gradient of a layer's output and give that of its input; the layer keeps its
parameters' gradients until the optimiser's step. One step of the optimiser has one number, whatever
the epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACT: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda z: z, lambda z: np.ones_like(z)),
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), lambda z: (s := 1 / (1 + np.exp(-z))) * (1 - s)),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
}


@dataclass
class Adam:
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    step: int = 0
    memory: dict = field(default_factory=dict)

    def update(self, params: dict[tuple, np.ndarray], grads: dict[tuple, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            m, v = self.memory.get(k, (0.0, 0.0))
            m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            self.memory[k] = m, v
            params[k] -= self.rate * (m / (1 - self.beta1**self.step)) / (np.sqrt(v / (1 - self.beta2**self.step)) + self.eps)


class Layer:
    """Parameters by name; `forward` remembers what `backward` needs."""

    def __init__(self, act: str = "linear") -> None:
        self.kind = act.lower()
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}

    def act(self, z: np.ndarray) -> np.ndarray:
        return ACT[self.kind][0](z)

    def slope(self, z: np.ndarray) -> np.ndarray:
        return ACT[self.kind][1](z)

    def forward(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def backward(self, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def uniform(rng: np.random.Generator, bound: float, *shape: int) -> np.ndarray:
    return rng.uniform(-bound, bound, shape)


class Dense(Layer):
    """activation(x W' + b) over rows."""

    def __init__(self, inputs: int, outputs: int, act: str = "linear", seed: int = 0) -> None:
        super().__init__(act)
        self.params = {"w": uniform(np.random.default_rng(seed), np.sqrt(2 / inputs), outputs, inputs), "b": np.zeros(outputs)}

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x, self.z = x, x @ self.params["w"].T + self.params["b"]
        return self.act(self.z)

    def backward(self, g: np.ndarray) -> np.ndarray:
        d = g * self.slope(self.z)
        self.grads = {"w": d.T @ self.x, "b": d.sum(0)}
        return d @ self.params["w"]


class Conv(Layer):
    """Valid convolution of (n, channel, row, column), by windows and one product."""

    def __init__(self, inputs: int, outputs: int, size: int, stride: int = 1, act: str = "linear", seed: int = 0) -> None:
        super().__init__(act)
        self.size, self.stride = size, stride
        self.params = {"w": uniform(np.random.default_rng(seed), np.sqrt(2 / (inputs * size * size)), outputs, inputs, size, size), "b": np.zeros(outputs)}

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, (self.size, self.size), axis=(2, 3))
        self.windows = view[:, :, :: self.stride, :: self.stride]
        self.z = np.einsum("ncijab,ocab->noij", self.windows, self.params["w"], optimize=True) + self.params["b"][:, None, None]
        return self.act(self.z)

    def backward(self, g: np.ndarray) -> np.ndarray:
        d = g * self.slope(self.z)
        self.grads = {"w": np.einsum("noij,ncijab->ocab", d, self.windows, optimize=True), "b": d.sum((0, 2, 3))}
        out = np.zeros(self.shape)
        rows, cols = d.shape[2:]
        for a in range(self.size):
            for b in range(self.size):
                out[:, :, a : a + rows * self.stride : self.stride, b : b + cols * self.stride : self.stride] += np.einsum("noij,oc->ncij", d, self.params["w"][:, :, a, b])
        return out


class Flatten(Layer):
    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g.reshape(self.shape)


class Recurrent(Layer):
    """h_t = activation(Wx x_t + Wh h_(t-1) + b) over (n, time, feature); gives every h."""

    def __init__(self, inputs: int, hidden: int, act: str = "tanh", seed: int = 0) -> None:
        super().__init__(act)
        rng, k = np.random.default_rng(seed), np.sqrt(1 / hidden)
        self.params = {"wx": uniform(rng, k, hidden, inputs), "wh": uniform(rng, k, hidden, hidden), "b": np.zeros(hidden)}

    def forward(self, x: np.ndarray) -> np.ndarray:
        p, n = self.params, len(x)
        self.x, self.h, self.z = x, [np.zeros((n, len(p["b"])))], []
        for t in range(x.shape[1]):
            self.z.append(x[:, t] @ p["wx"].T + self.h[-1] @ p["wh"].T + p["b"])
            self.h.append(self.act(self.z[-1]))
        return np.stack(self.h[1:], axis=1)

    def backward(self, g: np.ndarray) -> np.ndarray:
        p = self.params
        grads, out, back = {k: np.zeros_like(v) for k, v in p.items()}, np.zeros_like(self.x), 0.0
        for t in reversed(range(g.shape[1])):
            d = (g[:, t] + back) * self.slope(self.z[t])
            grads["wx"] += d.T @ self.x[:, t]
            grads["wh"] += d.T @ self.h[t]
            grads["b"] += d.sum(0)
            out[:, t], back = d @ p["wx"], d @ p["wh"]
        self.grads = grads
        return out


class LSTM(Layer):
    """Gates forget, input, output (sigmoid) and candidate (tanh) in one matrix, in that order."""

    def __init__(self, inputs: int, hidden: int, seed: int = 0) -> None:
        super().__init__("tanh")
        rng, k, self.n = np.random.default_rng(seed), np.sqrt(1 / hidden), hidden
        bias = np.zeros(4 * hidden)
        bias[:hidden] = 1.0
        self.params = {"wx": uniform(rng, k, 4 * hidden, inputs), "wh": uniform(rng, k, 4 * hidden, hidden), "b": bias}

    def forward(self, x: np.ndarray) -> np.ndarray:
        p, n = self.params, self.n
        h, c = np.zeros((len(x), n)), np.zeros((len(x), n))
        self.x, self.steps, out = x, [], []
        for t in range(x.shape[1]):
            z = x[:, t] @ p["wx"].T + h @ p["wh"].T + p["b"]
            gates, cand = 1 / (1 + np.exp(-z[:, : 3 * n])), np.tanh(z[:, 3 * n :])
            f, i, o = np.split(gates, 3, axis=1)
            new = f * c + i * cand
            self.steps.append((h, c, f, i, o, cand, np.tanh(new)))
            c = new
            h = o * self.steps[-1][-1]
            out.append(h)
        return np.stack(out, axis=1)

    def backward(self, g: np.ndarray) -> np.ndarray:
        p = self.params
        grads, out = {k: np.zeros_like(v) for k, v in p.items()}, np.zeros_like(self.x)
        dh, dc = 0.0, 0.0
        for t in reversed(range(g.shape[1])):
            h, c, f, i, o, cand, squashed = self.steps[t]
            whole = g[:, t] + dh
            dc = dc + whole * o * (1 - squashed**2)
            d = np.hstack([dc * c * f * (1 - f), dc * cand * i * (1 - i), whole * squashed * o * (1 - o), dc * i * (1 - cand**2)])
            grads["wx"] += d.T @ self.x[:, t]
            grads["wh"] += d.T @ h
            grads["b"] += d.sum(0)
            out[:, t], dh, dc = d @ p["wx"], d @ p["wh"], dc * f
        self.grads = grads
        return out


class Last(Layer):
    """The last time step of a sequence."""

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.shape = x.shape
        return x[:, -1]

    def backward(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape)
        out[:, -1] = g
        return out


def parameters(spark: SparkSession, named: dict[str, np.ndarray]) -> DataFrame:
    """(name, place, value) of named arrays, to be written in any format."""
    rows = [(n, i, float(v)) for n, a in named.items() for i, v in enumerate(a.ravel())]
    return spark.createDataFrame(rows, "name string, place int, value double")


def put_back(named: dict[str, np.ndarray], saved: DataFrame) -> None:
    """Values of `parameters` put into arrays of the same names and sizes."""
    found: dict[str, list[float]] = {}
    for r in saved.where(F.col("name").isin(list(named))).orderBy("name", "place").toLocalIterator():
        found.setdefault(r["name"], []).append(r["value"])
    for n, a in named.items():
        if len(found.get(n, ())) != a.size:
            raise ValueError(f"{n}: {a.size} values wanted, {len(found.get(n, ()))} found")
        a[...] = np.array(found[n]).reshape(a.shape)


#: (loss by row, gradient by output) of outputs and targets.
LOSSES: dict[str, tuple[Callable, Callable]] = {
    "mse": (lambda o, t: ((o - t) ** 2).mean(1), lambda o, t: 2 * (o - t) / o.shape[1]),
    "bce": (lambda o, t: -(t * np.log(o + 1e-10) + (1 - t) * np.log(1 - o + 1e-10)).mean(1), lambda o, t: (o - t) / (o * (1 - o) + 1e-10)),
    "ce": (lambda o, t: -(t * np.log(o + 1e-10)).sum(1), lambda o, t: o - t),
}


@dataclass
class Network:
    """Layers in a row with a loss by name, or own (loss, gradient) functions."""

    layers: list[Layer]
    loss: str | tuple[Callable, Callable] = "mse"

    def functions(self) -> tuple[Callable, Callable]:
        return LOSSES[self.loss] if isinstance(self.loss, str) else self.loss

    def predict(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def params(self) -> dict[tuple, np.ndarray]:
        return {(k, n): v for k, layer in enumerate(self.layers) for n, v in layer.params.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 1, adam: Adam | None = None) -> list[float]:
        """Mean loss of each epoch; rows in the order given."""
        adam, losses = adam or Adam(), []
        value, slope = self.functions()
        params = self.params()
        for _ in range(epochs):
            total = 0.0
            for at in range(0, len(x), batch):
                out, target = self.predict(x[at : at + batch]), y[at : at + batch]
                total += float(np.sum(value(out, target)))
                g = slope(out, target) / len(out)
                for layer in reversed(self.layers):
                    g = layer.backward(g)
                adam.update(params, {(k, n): v for k, layer in enumerate(self.layers) for n, v in layer.grads.items()})
            losses.append(total / max(1, len(x)))
        return losses

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, place, value) of all parameters."""
        return parameters(spark, {f"{k}.{n}": a for (k, n), a in self.params().items()})

    def restore(self, saved: DataFrame) -> Network:
        """Parameters of `table` put back."""
        put_back({f"{k}.{n}": a for (k, n), a in self.params().items()}, saved)
        return self

    def score(self, df: DataFrame, features: str = "features", out: str = "prediction", shape: Sequence[int] = ()) -> DataFrame:
        """Outputs for whole tables, a batch at a time; `shape` is that of one row's features."""
        held = df.sparkSession.sparkContext.broadcast(self)

        def run(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype="object")
            x = np.stack([np.asarray(v, dtype=float).reshape(shape or (-1,)) for v in column])
            return pd.Series(list(held.value.predict(x).reshape(len(x), -1)))

        return df.withColumn(out, F.pandas_udf(run, "array<double>")(features))


def non_max_suppression(boxes: np.ndarray, scores: np.ndarray, overlap: float = 0.5, least: float = 0.0) -> list[int]:
    """Indices of (x0, y0, x1, y1) boxes kept, best first."""
    order = [i for i in np.argsort(-scores, kind="stable") if scores[i] >= least]
    area = (boxes[:, 2] - boxes[:, 0]).clip(0) * (boxes[:, 3] - boxes[:, 1]).clip(0)
    kept: list[int] = []
    for i in order:
        if kept:
            other = boxes[kept]
            side = np.minimum(other[:, 2:], boxes[i, 2:]) - np.maximum(other[:, :2], boxes[i, :2])
            meet = side.clip(0).prod(1)
            if (meet / (area[kept] + area[i] - meet + 1e-10) > overlap).any():
                continue
        kept.append(int(i))
    return kept


@dataclass
class Detector:
    """Objects on a grid by one network: for each of `grid` x `grid` cells and each anchor (width, height),
    an offset (x, y) in the cell, a scale of the anchor (w, h), a confidence and a score for each class."""

    network: Network
    grid: int
    classes: int
    anchors: Sequence[tuple[float, float]]

    def loss(self, output: np.ndarray, target: np.ndarray) -> float:
        """The network's loss of one flat output against its target."""
        return float(self.network.functions()[0](output.reshape(1, -1), target.reshape(1, -1))[0])

    def boxes(self, output: np.ndarray) -> np.ndarray:
        """Rows (x0, y0, x1, y1, score, class), the whole picture being 1 x 1."""
        raw = output.reshape(self.grid, self.grid, len(self.anchors), 5 + self.classes)
        rise = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        at = np.stack(np.meshgrid(np.arange(self.grid), np.arange(self.grid)), axis=2)[:, :, None]
        center = (rise(raw[..., :2]) + at) / self.grid
        half = np.asarray(self.anchors) * np.exp(np.clip(raw[..., 2:4], -10, 10)) / 2
        kinds = rise(raw[..., 5:])
        score = rise(raw[..., 4]) * kinds.max(-1)
        return np.concatenate([center - half, center + half, score[..., None], kinds.argmax(-1)[..., None]], axis=-1).reshape(-1, 6)

    def objects(self, output: np.ndarray, least: float = 0.5, overlap: float = 0.5) -> np.ndarray:
        """Boxes of `least` score or more, those that overlap a better one of their class left out."""
        found = self.boxes(output)
        kept = [found[of][non_max_suppression(found[of, :4], found[of, 4], overlap, least)] for of in (found[:, 5] == k for k in range(self.classes))]
        rows = np.concatenate(kept)
        return rows[np.argsort(-rows[:, 4], kind="stable")]

    def predict_objects(self, df: DataFrame, features: str, shape: Sequence[int], least: float = 0.5, overlap: float = 0.5, out: str = "objects") -> DataFrame:
        """Objects of every row of a table, a batch at a time."""
        held = df.sparkSession.sparkContext.broadcast(self)

        def run(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype="object")
            x = np.stack([np.asarray(v, dtype=float).reshape(shape) for v in column])
            return pd.Series([held.value.objects(o, least, overlap).tolist() for o in held.value.network.predict(x)], dtype="object")

        return df.withColumn(out, F.pandas_udf(run, "array<array<double>>")(features))
