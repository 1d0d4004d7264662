"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC response records; a file holds the records of FILE_IDS neighbouring page ids, in
order, so offsets are sums within a file. A replica is read from its own WARC files: every record's
bytes are hashed as they stand there, and a catalogue (record id to page id) tells whose they are.

Every replica has a tree. A leaf hashes the records of one page id and digest. A node hashes its ordered
children, each with the range of offsets that it takes up from the node's begin on; ranges are relative, so a lost
record changes its own branch and no other, though all records after it have moved. Up to the page id, nodes
part by the next character of the digest (only as far as the most versions of one page need); above it, FANOUT
neighbouring ids share a node, up to one root. An audit compares the roots and goes down
only below nodes that differ, so equal branches are never read beyond their top.

Defined results: null url or html counts as empty, however long it may be; pages without an id are not
archived; page_id identifies a record. Rows that repeat one are its versions, ordered by digest; equal
ones are copies, and the lowest places among them are the missing ones. Where a page has records on one side only,
as many as the other side has instead are changed, by ascending digest, and the rest missing or extra.
Records that the catalogue does not know are extra. An empty archive has no root and equals an empty
one. Other columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, run_dir, table

FILE_IDS, FANOUT = 1024, 16
END = "\r\n\r\n"
#: Fixed values of the format.
BLOCK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADS = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:", ">\r\nWARC-Target-URI: ", "\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ")


def records(pages: DataFrame) -> DataFrame:
    """page_id, file_no, record_id, record (header and block, without the closing blank lines), length with them."""
    block = F.concat(F.lit(BLOCK), F.coalesce("html", F.lit("")))
    rows = pages.where(F.col("page_id").isNotNull()).select("page_id", F.coalesce("url", F.lit("")).alias("url"), block.alias("block"))
    rows = rows.withColumn("record_id", record_id(F.col("page_id"), F.col("url")))
    said = F.concat(F.lit(HEADS[0]), "record_id", F.lit(HEADS[1]), "url", F.lit(HEADS[2]), F.octet_length("block").cast("string"), F.lit(END), "block")
    made = rows.select("page_id", F.floor(F.col("page_id") / FILE_IDS).alias("file_no"), "record_id", said.alias("record"))
    return made.withColumn("length", F.octet_length("record").cast("bigint") + len(END))


def record_id(page_id: Column, url: Column) -> Column:
    name = F.md5(F.concat_ws("|", page_id.cast("string"), url))
    return F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def catalogue(pages: DataFrame) -> DataFrame:
    """record_id, page_id of what should be archived."""
    known = pages.where(F.col("page_id").isNotNull())
    return known.select(record_id(F.col("page_id"), F.coalesce("url", F.lit(""))).alias("record_id"), "page_id").distinct()


def write_warc(made: DataFrame, path: str) -> None:
    """One folder a file number, gzip files of up to FILE_IDS records in it; the closing blank lines are
    the line ends. Ranges part large files among tasks."""
    order = ["file_no", "page_id", "length"]
    dealt = made.repartitionByRange(*order).sortWithinPartitions("file_no", "page_id", "record")
    dealt.select("file_no", "record").write.partitionBy("file_no").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_IDS).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str, str, str, bytes]]:
    """(offset, length, record id, digest, target, block) of each record; the whole may be gzip. The
    digest is of the bytes as they stand, closing blank lines included."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (head := data.find(b"\r\n\r\n", at)) >= 0:
        fields = dict(line.split(b": ", 1) for line in data[at:head].split(b"\r\n")[1:] if b": " in line)
        size = int(fields.get(b"Content-Length", b"0"))
        stop = head + 4 + size + 4
        name = fields.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:uuid:").removesuffix(b">")
        yield at, stop - at, name.decode(), hashlib.sha256(data[at:stop]).hexdigest(), fields.get(b"WARC-Target-URI", b"").decode(), data[head + 4 : head + 4 + size]
        at = stop


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """file, offset, length, record_id, digest, url and, unless left out, block of the records of all files under a path."""
    names = ["file", "offset", "length", "record_id", "digest", "url", "block"][: None if blocks else -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                if rows := [(name, *r)[: len(names)] for r in parse_warc(content)]:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset bigint, length bigint, record_id string, digest string, url string" + ", block binary" * blocks)


def replica(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """page_id (null if the catalogue does not know the record), length, digest of the records under a path."""
    return read_warc(spark, path, blocks=False).join(known, "record_id", "left").select("page_id", "length", "digest")


def manifest(made: DataFrame) -> DataFrame:
    """page_id, file_no, place and offset in the file, copy among equal records (from 1), length, digest
    of the record's bytes."""
    w, same = (Window.partitionBy(*by).orderBy("page_id", "digest") for by in (["file_no"], ["file_no", "page_id", "digest"]))
    rows = made.select("page_id", "file_no", "length", F.sha2(F.concat("record", F.lit(END)), 256).alias("digest"))
    return rows.select(
        "page_id",
        "file_no",
        (F.row_number().over(w) - 1).cast("bigint").alias("place"),
        (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
        F.row_number().over(same).alias("copy"),
        "length",
        "digest",
    )


def leaves(rows: DataFrame) -> DataFrame:
    """page_id, digest, copies and their length together, of the records of known pages."""
    return rows.where(F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.count("*").alias("copies"), F.sum("length").alias("length"))


@dataclass
class Tree:
    """Levels from the leaves up, each (a, b, length, hash). a is the page id, from the lowest, or its
    group; b the beginning of the digest. The first `inner` steps up are within page ids."""

    levels: list[DataFrame]
    inner: int

    def parent(self, level: int) -> tuple[Column, Column]:
        """Keys of the parents of a level's nodes."""
        if level < self.inner:
            return F.col("a"), F.substring("b", 1, self.inner - 1 - level)
        return F.floor(F.col("a") / FANOUT), F.lit("")


def extent(of: DataFrame) -> tuple[int, int, int] | None:
    """Lowest and highest page id, most digests of one."""
    got = of.groupBy("page_id").count().agg(F.min("page_id"), F.max("page_id"), F.max("count")).first()
    return None if got[0] is None else tuple(got)


def tree(of: DataFrame, low: int, high: int, most: int) -> Tree:
    """The tree over leaves of page ids low to high, each level written once; a node gathers FANOUT
    children, or within a page id as many on average as there are digests of the same beginning."""
    first = F.sha2(F.concat_ws("x", "digest", "copies"), 256)
    made = Tree([of.select((F.col("page_id") - low).alias("a"), F.col("digest").alias("b"), "length", first.alias("hash"))], 1 + max(0, math.ceil(math.log(most / FANOUT, 16))))
    level, ids = 0, high - low
    while level < made.inner or ids:
        if level >= made.inner:
            ids //= FANOUT
        a, b = made.parent(level)
        child = F.struct("a", "b", "length", "hash")
        state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("said"))
        put = lambda s, c: F.struct((s["at"] + c["length"]).alias("at"), F.concat(s["said"], F.format_string("%d-%d:%s|", s["at"], s["at"] + c["length"], c["hash"])).alias("said"))
        said = F.aggregate(F.array_sort(F.collect_list(child)), state, put, lambda s: s["said"])
        up = made.levels[-1].groupBy(a.alias("pa"), b.alias("pb")).agg(F.sum("length").alias("length"), F.sha2(said, 256).alias("hash"))
        made.levels.append(cut(up.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "length", "hash")))
        level += 1
    return made


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page_id, digest) of the leaves that differ, found from the roots down."""
    none = ours.select("page_id", "digest").where("false")
    sizes = [x for x in (extent(ours), extent(theirs)) if x]
    if not sizes:
        return none
    span = min(x[0] for x in sizes), max(x[1] for x in sizes), max(x[2] for x in sizes)
    a, b = tree(ours, *span), tree(theirs, *span)
    wrong = None
    for level in range(len(a.levels) - 1, -1, -1):
        sides = []
        for t, name in ((a, "x"), (b, "y")):
            nodes = t.levels[level].select("a", "b", F.struct("length", "hash").alias(name))
            if wrong is not None:
                pa, pb = t.parent(level)
                nodes = nodes.withColumns({"pa": pa, "pb": pb}).join(wrong, ["pa", "pb"], "left_semi").select("a", "b", name)
            sides.append(nodes)
        differ = sides[0].join(sides[1], ["a", "b"], "full").where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False)))
        differ = cut(differ.select("a", "b"))
        if not differ.take(1):
            return none
        wrong = differ.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    return differ.select((F.col("a") + span[0]).alias("page_id"), F.col("b").alias("digest"))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(page_id, digest, status, copies) of the records that differ, from rows page_id, digest, length:
    changed or missing (ours), extra (theirs)."""
    mine, other = cut(leaves(ours)), cut(leaves(theirs))
    at = cut(differing(mine, other))
    key = ["page_id", "digest"]
    counts = at.join(mine.select(*key, F.col("copies").alias("n")), key, "left").join(other.select(*key, F.col("copies").alias("m")), key, "left")
    counts = counts.select(*key, (F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("lost"))
    page = Window.partitionBy("page_id")
    side = lambda c: F.greatest(c, F.lit(0))
    up_to = lambda c: F.sum(c).over(page.orderBy("digest")) - c
    gone, new = side(F.col("lost")), side(-F.col("lost"))
    told = counts.withColumns({"gone": gone, "new": new, "gone_before": up_to(gone), "new_before": up_to(new), "all_gone": F.sum(gone).over(page), "all_new": F.sum(new).over(page)})
    changed = F.least(F.col("gone"), side(F.col("all_new") - F.col("gone_before")))
    replaced = F.least(F.col("new"), side(F.col("all_gone") - F.col("new_before")))
    kinds = F.array(*(F.struct(F.lit(k).alias("status"), n.alias("copies")) for k, n in (("changed", changed), ("missing", F.col("gone") - changed), ("extra", F.col("new") - replaced))))
    found = told.select(*key, F.inline(kinds)).where("copies > 0")
    unknown = theirs.where(F.col("page_id").isNull()).groupBy(*key).agg(F.count("*").alias("copies"))
    return found.unionByName(unknown.select(*key, F.lit("extra").alias("status"), "copies"))


def damaged(made: DataFrame) -> DataFrame:
    """Records of a replica for tests and the query: of 256 classes of page ids one has another byte, one is lost."""
    kind = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    other = F.replace("record", F.lit("WARC-Date: 1970-"), F.lit("WARC-Date: 1971-"))
    return made.where(kind != "01").withColumn("record", F.when(kind == "00", other).otherwise(F.col("record")))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages, and how each fares in a replica that is written with damages and read back
    from its files."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = records(pages)
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(damaged(made), path)
    ours = cut(manifest(made))
    found = audit(ours, cut(replica(spark, path, catalogue(pages)))).where("status <> 'extra'")
    found = found.groupBy("page_id", "digest").agg(*(F.coalesce(F.sum(F.when(F.col("status") == k, F.col("copies"))), F.lit(0)).alias(k) for k in ("missing", "changed")))
    joined = ours.join(found, ["page_id", "digest"], "left")
    status = F.when(F.col("copy") <= F.col("missing"), "missing").when(F.col("copy") <= F.col("missing") + F.col("changed"), "changed").otherwise("intact")
    return joined.select("page_id", "file_no", "place", "offset", "length", "digest", status.alias("status"))


SQL = """
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS file_no, coalesce(url, '') AS url,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS block,
         md5(CAST(page_id AS VARCHAR) || '|' || coalesce(url, '')) AS m
  FROM pages WHERE page_id IS NOT NULL),
w AS (
  SELECT page_id, file_no, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
         || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(block) AS VARCHAR)
         || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10) AS said
  FROM r),
h AS (SELECT page_id, file_no, CAST(strlen(said) AS BIGINT) AS length, sha256(said) AS digest FROM w)
SELECT page_id, file_no, row_number() OVER f - 1 AS place, CAST(sum(length) OVER f - length AS BIGINT) AS "offset", length, digest,
       CASE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'intact' END AS status
FROM h WINDOW f AS (PARTITION BY file_no ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING)
"""
