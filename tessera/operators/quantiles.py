"""Exact quantiles of columns that no single task could hold: ranks are looked up by counts of leading bits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bits counted at first, and in each later reading; number of values that are read at once when so few are left.
FIRST, NEXT, LEFT = 16, 12, 200_000
TOP = np.uint64(1 << 63)


def bits(x: np.ndarray) -> np.ndarray:
    """Numbers whose order is that of the values; zeros are one, NaN is the last."""
    x = x + 0.0
    x[np.isnan(x)] = np.nan
    u = x.view(np.uint64)
    return np.where(u & TOP, ~u, u | TOP)


def back(keys: np.ndarray) -> np.ndarray:
    """The values of such numbers."""
    return np.where(keys & TOP, keys ^ TOP, ~keys).view(float)


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its values at `shares` of the way through its non-null values, linear between two; null if
    there are none. A reading counts values by their leading bits, the next ones do so within the bins that hold a
    wanted rank; what reaches the driver is bounded by the bins, whatever the number of rows or distinct values."""
    names = list(columns)
    values = df.select(*(columns[c].cast("double").alias(f"_{k}") for k, c in enumerate(names)))
    bins, known = {(k, 0): 0 for k in range(len(names))}, 0  # (column, leading bits): rows before
    ranks: dict[tuple[int, int], list[int]] = {}
    sizes: dict[int, int] = {}
    found: dict[tuple[int, int], float] = {}
    while bins:
        more = min(NEXT, 64 - known) if known else FIRST
        inner: dict[tuple[int, int], int] = {}
        within: dict[tuple[int, int], list[int]] = {}
        left = 0
        for (k, prefix), counts in read(values, sorted(bins), known, more).items():
            if not known:
                n = sizes[k] = sum(x[1] for x in counts)
                ranks[k, 0] = sorted({int(r) for s in shares for r in (np.floor(s * (n - 1)), np.ceil(s * (n - 1)))}) if n else []
            ends = np.cumsum([x[1] for x in counts]) + bins[k, prefix]
            for r in ranks[k, prefix]:
                at = int(np.searchsorted(ends, r, side="right"))
                digit, n, low, high = counts[at]
                key = (k, prefix << more | digit)
                if low == high or known + more == 64:
                    found[k, r] = low if low == high else float(back(np.array([key[1]], dtype=np.uint64))[0])
                    continue
                left += 0 if key in inner else n
                inner[key] = int(ends[at]) - n
                within.setdefault(key, []).append(r)
        bins, ranks, known = inner, within, known + more
        if bins and left <= LEFT:
            for (k, prefix), x in read(values, sorted(bins), known, 0).items():
                found |= {(k, r): float(x[r - bins[k, prefix]]) for r in ranks[k, prefix]}
            break
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(names):
        out[c] = []
        for s in shares:
            if not sizes[k]:
                out[c].append(None)
                continue
            at = s * (sizes[k] - 1)
            low, high = found[k, int(np.floor(at))], found[k, int(np.ceil(at))]
            out[c].append(low if np.floor(at) == np.ceil(at) or low == high else low + (at - np.floor(at)) * (high - low))
    return out


def read(values: DataFrame, bins: Sequence[tuple[int, int]], known: int, more: int) -> dict:
    """For each bin of `known` leading bits the (digit, count, least, most) of its next `more` bits in order, or
    without more bits its sorted values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(bins), 1 << more), dtype=np.int64)
        low, high = np.full((len(bins), 1), np.inf), np.full((len(bins), 1), -np.inf)
        for batch in batches:
            keys: dict[int, np.ndarray] = {}
            for b, (k, prefix) in enumerate(bins):
                if k not in keys:
                    keys[k] = bits(batch.column(k).drop_null().to_numpy(zero_copy_only=False))
                key = keys[k][keys[k] >> np.uint64(64 - known) == np.uint64(prefix)] if known else keys[k]
                if not len(key):
                    continue
                if not more:
                    yield pa.record_batch([pa.array(np.full(len(key), b)), pa.array(back(key)), pa.array(np.ones(len(key), dtype=np.int64)), pa.array(back(key)), pa.array(back(key))], names=["b", "digit", "n", "low", "high"])
                    continue
                counts[b] += np.bincount((key >> np.uint64(64 - known - more) & np.uint64((1 << more) - 1)).astype(np.int64), minlength=1 << more)
                if known:
                    ends = back(np.array([key.min(), key.max()]))
                    low[b], high[b] = min(low[b, 0], ends[0]), max(high[b, 0], ends[1])
        if more:
            b, digit = np.nonzero(counts)
            yield pa.record_batch([pa.array(b.astype(np.int64)), pa.array(digit.astype(float)), pa.array(counts[b, digit]), pa.array(low[b, 0]), pa.array(high[b, 0])], names=["b", "digit", "n", "low", "high"])

    rows = values.mapInArrow(run, "b bigint, digit double, n bigint, low double, high double")
    got: dict[tuple[int, int], list] = {b: [] for b in bins}
    if not more:
        for b, x in rows.select("b", "digit").collect():
            got[bins[b]].append(x)
        return {b: back(np.sort(bits(np.array(x, dtype=float)))) for b, x in got.items()}
    for r in rows.groupBy("b", "digit").agg(F.sum("n"), F.min("low"), F.max("high")).collect():
        got[bins[r[0]]].append((int(r[1]), *r[2:]))
    for b, x in got.items():
        least, most = min((r[2] for r in x), default=0.0), max((r[3] for r in x), default=0.0)
        got[b] = sorted((d, n, least, most) for d, n, _, _ in x)
    return got

