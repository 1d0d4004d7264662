"""Words, vocabularies and sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Share of the documents from which a token counts as common.
COMMON = 0.001
#: Bytes of text whose words are counted at once.
SLICE = 1 << 22


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; empty ones go."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"\p{Punct}", ""))
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("at", "token"))


def vocabulary(df: DataFrame, key: str, text: str, size: int = 10_000) -> DataFrame:
    """(token, df, id) of the `size` tokens in most documents; ids from 2 by (df, token) descending."""
    counts = df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    top = counts.orderBy(F.desc("df"), F.desc("token")).limit(size)
    return top.select("token", "df", (F.row_number().over(Window.orderBy(F.desc("df"), F.desc("token"))) + 1).alias("id"))


def sequences(df: DataFrame, key: str, text: str, vocab: DataFrame, length: int) -> DataFrame:
    """ids of the first `length` tokens, unknown 1, padded with 0. Only those tokens are joined."""
    first = df.select(key, F.posexplode(F.slice(tokens(F.col(text)), 1, length)).alias("at", "token"))
    known = first.join(F.broadcast(vocab.select("token", "id")), "token", "left").select(key, "at", F.coalesce("id", F.lit(1)).alias("id"))
    rows = known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return df.select(key).join(rows, key, "left").select(key, F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length).alias("ids"))


def counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n, size): each token's count in a document and the document's number of tokens. A document's
    tokens are counted where its row is; only if a key has several rows do their counts meet."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = pa.compute.split_pattern(part.column(1), " ")
                codes, size = words.flatten().dictionary_encode(), pa.compute.list_value_length(words).to_numpy(zero_copy_only=False)
                names = codes.dictionary
                pair, n = np.unique(pa.compute.list_parent_indices(words).to_numpy().astype(np.int64) * len(names) + codes.indices.to_numpy(), return_counts=True)
                row, token = np.divmod(pair, max(1, len(names)))
                yield pa.record_batch([part.column(0).take(pa.array(row)), names.take(pa.array(token)), pa.array(n.astype(np.int64)), pa.array(size[row].astype(np.int64))], names=[key, "token", "n", "size"])

    # words hold no white space, so one space between them can be undone
    lines = df.select(key, F.array_join(tokens(F.col(text)), " ").alias("_line")).where(F.col("_line") != "")
    bag = lines.mapInArrow(run, f"`{key}` {kind}, token string, n bigint, size bigint")
    if df.groupBy(key).count().where("count > 1").take(1):
        bag = bag.groupBy(key, "token").agg(F.sum("n").alias("n"))
        bag = bag.withColumn("size", F.sum("n").over(Window.partitionBy(key)))
    return bag


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, of about SLICE bytes of text."""
    ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def bag_of_words(df: DataFrame, key: str, text: str) -> DataFrame:
    return counted(df, key, text).select(key, "token", "n")


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): share of the document's tokens x ln(documents / documents with the token)."""
    n = df.count()
    bag = counted(df, key, text)
    docs = bag.groupBy("token").agg(F.count("*").alias("df"))
    # tokens of COMMON of the documents or more are at most (tokens a document) / COMMON: they go to every task
    common = docs.where(F.col("df") >= COMMON * n)
    known = bag.join(F.broadcast(common), "token", "left")
    rare = known.where(F.col("df").isNull()).drop("df").join(docs.where(F.col("df") < COMMON * n), "token")
    both = known.where(F.col("df").isNotNull()).unionByName(rare)
    return both.select(key, "token", (F.col("n") / F.col("size") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))
