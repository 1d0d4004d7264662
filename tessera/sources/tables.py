"""Reading and writing tables: delimited text with type inference, Parquet, vectors, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that read as null.
NULL_TOKENS = ("", "NA", "null", "NaN")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Delimited text without quoting rules: cells are trimmed, one outer pair of quotes goes, null
    tokens and missing cells are null. A column whose every value is a number is double, else string;
    one pass over the data decides for all columns. An empty file gives a frame without columns."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        first = lines.head(1)
        if not first:
            return spark.createDataFrame([], T.StructType([]))
        names = [cell.strip().strip('"') for cell in first[0][0].split(delimiter)]
        rows = spark.read.csv(path, sep=delimiter, header=True, quote="", mode="PERMISSIVE", schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    else:
        width = lines.agg(F.max(F.size(F.split("value", f"\\Q{delimiter}\\E")))).first()[0] or 0
        names = [f"col_{k}" for k in range(width)]
        rows = spark.read.csv(path, sep=delimiter, header=False, quote="", schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    bare = rows.select(*(cell(F.col(f"`{n}`")).alias(n) for n in names))
    texts = bare.agg(*(F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast("double").isNull()).alias(n) for n in names)).first()
    return bare.select(*(F.col(f"`{n}`") if texts[n] else F.col(f"`{n}`").cast("double").alias(n) for n in names))


def cell(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")
    return F.when(bare.isin(*NULL_TOKENS), None).otherwise(bare)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Header and rows; null is NA, doubles have six decimals."""
    as_text = [F.when(F.col(f).isNotNull(), F.format_string("%.6f", F.col(f))).alias(f) if t in ("double", "float") else F.col(f) for f, t in df.dtypes]
    df.select(*as_text).write.csv(path, sep=delimiter, header=True, nullValue="NA", quote="", emptyValue="")


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Schema, nulls and data."""
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, order: Sequence[Column | str], max_rows: int = 10, width: int = 12) -> str:
    """First and last rows by an order, cells cut to the width; only those rows reach the driver."""
    n = df.count()
    cut = lambda v: str("NA" if v is None else v)[: width - 1].ljust(width)
    head = [cut(c) for c in df.columns]
    ordered = df.orderBy(*order)
    rows = ordered.limit(max_rows).collect() if n <= max_rows else [*ordered.limit(max_rows // 2).collect(), None, *ordered.offset(n - (max_rows - max_rows // 2)).collect()]
    body = [f"... ({n} rows total)" if r is None else "".join(map(cut, r)) for r in rows]
    return "\n".join(["".join(head), *body, f"[{n} rows x {len(df.columns)} columns]"])


def from_vectors(spark: SparkSession, rows: Sequence[Sequence[float]], names: Sequence[str] = ()) -> DataFrame:
    """Rows of numbers as double columns, as wide as the first; short rows end in 0, names in col_k."""
    width = len(rows[0]) if rows else len(names)
    names = [*names[:width], *(f"col_{k}" for k in range(len(names), width))]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.createDataFrame([tuple([*map(float, r[:width]), *([0.0] * (width - len(r)))]) for r in rows], schema)


def to_vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """`df` with a dense vector of the columns; null and text read 0."""
    return df.withColumn(out, F.array(*(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns)))


def collected(df: DataFrame, column: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """One ordered array of a column a partition key; null reads 0."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("_v"))))
    return df.groupBy(*partition_by).agg(F.transform(cells, lambda s: s["_v"]).alias(column))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file under a path: path and whole text."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
