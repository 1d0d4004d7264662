"""Selection, filters, order, joins, grouping, pivots and profiles of whole frames.

Rows have no position in Spark: whatever depends on order takes the keys of a total order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import quantiles

Keys = Sequence[str | Column]


def numeric(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*(c for c in columns if c in df.columns))


def apply_column(df: DataFrame, column: str, fn: Callable[[Column], Column], out: str | None = None) -> DataFrame:
    """`fn` of a column in its place, or under another name."""
    return df.withColumn(out or column, fn(F.col(column)))


def add_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows appended by name; columns that one side lacks are null there."""
    return df.unionByName(other, allowMissingColumns=True)


def drop_nulls(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Rows without a null in the columns (all by default); NaN is a value."""
    return df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns or df.columns), F.lit(True)))


def ascending(order: Keys) -> list[Column]:
    return [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in order]


def drop_duplicates(df: DataFrame, subset: Sequence[str] = (), order: Keys = ()) -> DataFrame:
    """The first row by `order` of each key; all columns are the key by default."""
    if not subset or not order:
        return df.dropDuplicates(list(subset) or None)
    w = Window.partitionBy(*subset).orderBy(*ascending(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def head(df: DataFrame, n: int, order: Keys) -> DataFrame:
    return df.orderBy(*ascending(order)).limit(n)


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*(F.col(k).desc_nulls_first() for k in order)).limit(n)


def slice_rows(df: DataFrame, start: int, end: int, order: Keys) -> DataFrame:
    """Rows [start, end) of the order."""
    return df.orderBy(*ascending(order)).offset(start).limit(max(0, end - start))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for a seed at any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def sort(df: DataFrame, columns: Sequence[str], ascending_: Sequence[bool] | bool = True) -> DataFrame:
    """By typed values, nulls last in either direction."""
    ways = [ascending_] * len(columns) if isinstance(ascending_, bool) else ascending_
    return df.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(columns, ways)))


def positions(df: DataFrame, order: Keys, out: str = "pos", parts: int | None = None) -> DataFrame:
    """0-based position of each row in a total order, without one window over all rows: rows are dealt
    by ranges, counted by part, numbered within parts, and shifted by the counts before."""
    keys = ascending(order)
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    shifted = inside.join(F.broadcast(before.select("_part", "_before")), "_part")  # one row a part
    return shifted.withColumn(out, F.col("_in") - 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_in", "_before")


def running(df: DataFrame, order: Keys, sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Sums up to each row, itself among them, in a total order: rows are dealt by ranges and summed within
    them, and the last row of a range takes its sums to every later one. The limits of ranges are sampled,
    so they are read once: a second reading may draw others."""
    keys = ascending(order)
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    ranged = Window.partitionBy("_part").orderBy(*keys)
    inside = ranged.rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()} | {"_last": F.lead(F.lit(True)).over(ranged).isNull()})
    sent = summed.withColumn("_to", F.explode(F.when(F.col("_last"), F.sequence("_part", F.lit(n - 1))).otherwise(F.array("_part"))))
    own = F.col("_to") == F.col("_part")
    sent = sent.withColumns({c: F.when(own, F.col(f"`{c}`")) for c in df.columns if c not in sums})  # only sums travel
    earlier = Window.partitionBy("_to").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)  # one row a part
    placed = sent.withColumns({f"_b{k}": F.sum(name).over(earlier) for k, name in enumerate(sums)}).where(own)
    return placed.withColumns({name: F.coalesce(F.col(name) + F.col(f"_b{k}"), name, f"_b{k}") for k, name in enumerate(sums)}).drop("_part", "_last", "_to", *(f"_b{k}" for k in range(len(sums))))


def rank(df: DataFrame, column: str, order: Sequence[str], out: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Ordinal rank from 1 among the non-null values; null has none."""
    w = Window.partitionBy(*partition_by).orderBy(F.col(column).asc_nulls_last(), *order)
    return df.withColumn(out or f"{column}_rank", F.when(F.col(column).isNotNull(), F.row_number().over(w).cast("double")))


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on one or more columns; the key stands once, other names of the right that clash get
    `_right`. outer is a full outer join; null keys meet only if `null_safe`."""
    keys = [on] if isinstance(on, str) else list(on)
    how = {"outer": "full", "inner": "inner", "left": "left", "right": "right", "semi": "left_semi", "anti": "left_anti"}[how]
    if how in ("left_semi", "left_anti"):
        return left.join(right.select(*keys).distinct(), keys, how)
    renamed = right.select(*(F.col(c).alias(f"{c}_right" if c in left.columns and c not in keys else c) for c in right.columns))
    if not null_safe:
        return left.join(renamed, keys, how)
    mine = renamed.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, (left[k].eqNullSafe(mine[f"_{k}"]) for k in keys))
    joined = left.join(mine, same, how)
    take = (lambda k: F.coalesce(left[k], mine[f"_{k}"]).alias(k)) if how in ("full", "right") else (lambda k: left[k])
    return joined.select(*(take(c) if c in keys else left[c] for c in left.columns), *(c for c in mine.columns if c not in [f"_{k}" for k in keys]))


def asof(left: DataFrame, right: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right side's last `value` at or before its time, by union and window."""
    a = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    b = right.select(*by, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_v", "_side")


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)),
    "var": lambda c: F.coalesce(F.var_samp(c), F.lit(0.0)),
    "median": F.median,
    "count": F.count,
}


def group_agg(df: DataFrame, by: str | Sequence[str], values: dict[str, Sequence[str]]) -> DataFrame:
    """Named aggregates of value columns by key, as <value>_<aggregate>; partial before the shuffle."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(*(AGGREGATES[f](c).alias(f"{c}_{f}") for c, fs in values.items() for f in fs))


def pivot(df: DataFrame, index: str, columns: str, values: str, order: Keys, headers: Sequence | None = None) -> DataFrame:
    """index x columns, each cell the first value by `order`; headers are read first unless given."""
    if headers is None:
        headers = sorted(r[0] for r in df.select(columns).distinct().collect() if r[0] is not None)
    first = F.min_by(values, F.struct(*order))
    return df.groupBy(index).pivot(columns, list(headers)).agg(first)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of the non-null values, sorted by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").cast("int").alias("count")).orderBy(column)


def skewness(c: Column | str) -> Column:
    """Adjusted; 0 for under three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def kurtosis(c: Column | str) -> Column:
    """Adjusted excess; 0 for under four values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)).otherwise(0.0)


def unfolded(row: DataFrame, names: Sequence[str], parts: dict[str, Callable[[str], Column]], label: str) -> DataFrame:
    """One row a name from a one-row frame: column `label`, then each part."""
    items = F.array(*(F.struct(F.lit(n).alias(label), *(f(n).alias(k) for k, f in parts.items())) for n in names))
    return row.select(F.inline(items))


def null_report(df: DataFrame) -> DataFrame:
    """column, null_count, null_pct, valid_count; one pass for all columns."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(F.col(c)).alias(c) for c in df.columns))
    nulls = lambda c: F.col("_n") - F.col(c)
    parts = {
        "null_count": nulls,
        "null_pct": lambda c: F.when(F.col("_n") == 0, 0.0).otherwise(nulls(c) / F.col("_n") * 100),
        "valid_count": F.col,
    }
    return unfolded(one, df.columns, parts, "column")


STATISTICS: dict[str, Callable[[str], Column]] = {
    "count": lambda c: F.count(c).cast("double"),
    "mean": lambda c: F.avg(c).cast("double"),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c).cast("double"),
    "25%": lambda c: F.percentile(c, 0.25),
    "50%": lambda c: F.percentile(c, 0.5),
    "75%": lambda c: F.percentile(c, 0.75),
    "max": lambda c: F.max(c).cast("double"),
}


def describe(df: DataFrame, columns: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Eight statistics by numeric column; quartiles by sketch in one pass unless `exact`."""
    columns = list(columns) or numeric(df)
    if exact:
        held = quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
        quartiles = {f"{p}%": (lambda c, k=k: F.lit(held[c][k]).cast("double")) for k, p in enumerate((25, 50, 75))}
    else:
        quartiles = {f"{p}%": (lambda c, p=p: F.percentile_approx(c, p / 100).cast("double")) for p in (25, 50, 75)}
    how = STATISTICS | quartiles
    one = df.agg(*(f(c).alias(f"{s}|{c}") for s, f in how.items() for c in columns))
    return unfolded(one, list(how), {c: (lambda s, c=c: F.col(f"`{s}|{c}`")) for c in columns}, "statistic")


def matrix(df: DataFrame, columns: Sequence[str], fn: Callable[[Column, Column], Column], null_policy: str = "zero") -> DataFrame:
    """A symmetric function of all pairs of columns in one aggregate, as rows by column."""
    value = (lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if null_policy == "zero" else (lambda c: F.col(c).cast("double"))
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    one = df.agg(*(fn(value(a), value(b)).alias(f"{a}|{b}") for a, b in pairs))
    at = lambda a, b: F.col(f"`{a}|{b}`" if columns.index(a) <= columns.index(b) else f"`{b}|{a}`")
    return unfolded(one, list(columns), {b: (lambda a, b=b: at(a, b)) for b in columns}, "column")


def corr(df: DataFrame, columns: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Pearson matrix; null reads 0, or its pair is left out by 'pairwise'; 0 without spread."""
    safe = lambda a, b: F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)).otherwise(0.0)
    return matrix(df, list(columns) or numeric(df), safe, null_policy)


def cov(df: DataFrame, columns: Sequence[str] = (), null_policy: str = "zero") -> DataFrame:
    """Sample covariance matrix."""
    return matrix(df, list(columns) or numeric(df), F.covar_samp, null_policy)


def quality_report(df: DataFrame) -> DataFrame:
    """Nulls, distinct values and moments by column; moments of text are 0. One pass; distinct counts
    are exact and null is not counted among them."""
    nums = set(numeric(df))
    zero = F.lit(0.0)
    parts: dict[str, Callable[[str], Column]] = {
        "null_count": lambda c: F.count_if(F.col(c).isNull()),
        "null_pct": lambda c: F.coalesce(F.avg(F.col(c).isNull().cast("double")) * 100, zero),
        "distinct_count": lambda c: F.count_distinct(c),
        "mean": lambda c: F.coalesce(F.avg(c), zero) if c in nums else zero,
        "std": lambda c: F.coalesce(F.stddev_samp(c), zero) if c in nums else zero,
        "min": lambda c: F.min(c).cast("double") if c in nums else zero,
        "max": lambda c: F.max(c).cast("double") if c in nums else zero,
        "skewness": lambda c: skewness(c) if c in nums else zero,
        "kurtosis": lambda c: kurtosis(c) if c in nums else zero,
    }
    one = df.agg(*(f(c).alias(f"{k}|{c}") for k, f in parts.items() for c in df.columns))
    return unfolded(one, df.columns, {k: (lambda c, k=k: F.col(f"`{k}|{c}`")) for k in parts}, "column")
