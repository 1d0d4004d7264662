"""Functions of a column in order. All take the order's keys and optional partition keys; recurrences
are folds over one ordered array a partition key, or Arrow batches for long ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.operators.frame import positions


def spec(order: Sequence[str], by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def fill_forward(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: Column, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def shift(c: Column, w: WindowSpec, periods: int = 1) -> Column:
    """The value `periods` rows before (after, if negative)."""
    return F.lag(c, periods).over(w) if periods >= 0 else F.lead(c, -periods).over(w)


def diff(c: Column, w: WindowSpec, periods: int = 1) -> Column:
    return c - shift(c, w, periods)


def pct_change(c: Column, w: WindowSpec, periods: int = 1) -> Column:
    """Ratio to the earlier value; null if that is 0."""
    before = shift(c, w, periods)
    return (c - before) / F.nullif(before, F.lit(0.0))


def cumsum(c: Column, w: WindowSpec) -> Column:
    """Running sum; a null carries it, 0 before the first value."""
    return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def cumprod(c: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.product(c).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))


def rolling(c: Column, w: WindowSpec, width: int, how: str) -> Column:
    """mean, std (population, of two values at least), min or max of the last `width` rows, nulls left
    out; null until the window is full, and where it holds no value."""
    frame = w.rowsBetween(-(width - 1), 0)
    made = {
        "mean": lambda: F.avg(c).over(frame),
        "std": lambda: F.when(F.count(c).over(frame) > 1, F.stddev_pop(c).over(frame)),
        "min": lambda: F.min(c).over(frame),
        "max": lambda: F.max(c).over(frame),
    }[how]()
    return F.when(F.row_number().over(w) >= width, made)


def weighted_moving_average(c: Column, w: WindowSpec, weights: Sequence[float]) -> Column:
    """Weights of the last rows, the newest last; null until all are there."""
    terms = [shift(c, w, len(weights) - 1 - k) * float(v) for k, v in enumerate(weights)]
    return sum(terms[1:], terms[0]) / float(sum(weights))


def ewm_mean(df: DataFrame, column: str, alpha: float, order: Sequence[str], by: Sequence[str] = (), out: str = "ewm", batches: bool = False) -> DataFrame:
    """y = alpha x + (1 - alpha) y from the first value on; a null carries y, null before it. A fold
    over each key's ordered array; with `batches` one pass over the sorted rows of many keys in Arrow batches, which
    holds no key's rows together."""
    if batches:
        names, first = list(df.columns), lambda t: repr([t[c][0].as_py() for c in by])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, y = None, None
            for part in parts:
                if not part.num_rows:
                    continue
                own = pa.table({c: part[c] for c in by})
                new = np.zeros(part.num_rows, dtype=bool)
                for c in own.itercolumns():
                    codes = c.combine_chunks().dictionary_encode("encode").indices.to_numpy()
                    new[1:] |= codes[1:] != codes[:-1]
                new[0] = first(own) != held
                made = []
                for x, fresh in zip(part[column].cast(pa.float64()).to_pylist(), new.tolist()):
                    y = None if fresh else y
                    if x is not None and x == x:
                        y = x if y is None else alpha * x + (1 - alpha) * y
                    made.append(y)
                held = first(own.slice(part.num_rows - 1))
                yield pa.record_batch([*(part[c] for c in names), pa.array(made, pa.float64())], names=[*names, out])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` double"])
        keyed = df.repartition(*(F.col(c) for c in by)) if by else df.coalesce(1)
        return keyed.sortWithinPartitions(*by, *(F.col(c).asc_nulls_last() for c in order)).mapInArrow(run, schema)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order and c not in by)))).alias("_rows"))

    def step(acc: Column, row: Column) -> Column:
        x, y = row[column].cast("double"), F.try_element_at(acc, F.lit(-1))
        new = F.when(x.isNull(), y).when(y.isNull(), x).otherwise(alpha * x + (1 - alpha) * y)
        return F.concat(acc, F.array(new))

    folded = rows.withColumn("_y", F.aggregate("_rows", F.array().cast("array<double>"), step))
    each = folded.select(*by, F.explode(F.arrays_zip("_rows", "_y")).alias("_z"))
    return each.select(*by, "_z._rows.*", F.col("_z._y").alias(out))


def simple_moving_average(c: Column, w: WindowSpec, width: int) -> Column:
    """Trailing mean; values before the first full window pass as they are."""
    return F.when(F.row_number().over(w) < width, c).otherwise(F.avg(c).over(w.rowsBetween(-(width - 1), 0)))


def difference(df: DataFrame, column: str, order: Sequence[str], times: int = 1, lag: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """`times` differences at a lag; rows that lack a partner go."""
    w = spec(order, by)
    for _ in range(times):
        df = df.withColumn(column, diff(F.col(column), w, lag)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") > lag).drop("_n")
    return df


def label_encode(df: DataFrame, column: str, order: Sequence[str], out: str = "label") -> DataFrame:
    """Ids from 0 by first appearance; null stays null. The distinct values are numbered, then joined."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    ids = positions(firsts, ["_first"], "_id").select(column, F.col("_id").cast("int").alias(out))
    return df.join(ids, column, "left")


def one_hot_encode(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """A 0/1 column <column>_<value> for each distinct value; null stays null."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    return df.withColumns({f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in values})
