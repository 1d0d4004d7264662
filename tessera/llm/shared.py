"""Helpers of the training-data operators: tables, lineage cuts, bounded training samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of local sessions for which none is set.
OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one of its
    own; a cluster's executors would not share that, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        named = OWN[app] = OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder within the shared one."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has cut so far. Frames read from it must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends here, and a lost
    executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores after it as keep it apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, as the folds are dealt."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def bounded_sample(df: DataFrame, key: str, limit: int, salt: str) -> DataFrame:
    """`limit` rows at most, the lowest by a salted hash of the key: the same rows at any
    partitioning. Spark keeps `limit` rows a partition while it reads (TakeOrdered)."""
    order = F.xxhash64(F.lit(salt), F.col(key))
    return df.orderBy(order, F.col(key)).limit(limit)
