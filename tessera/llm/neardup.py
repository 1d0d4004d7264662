"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts become sets of hashed shingles of five words. Texts with the same set are one class, which
has one representative. A class has a label in every tree of the forest: LABEL MinHash values of 16
bits. The labels of a tree, sorted, are its prefix trie: neighbours in the order share the longest
prefixes, and the classes that share their first d values are a node of depth d. All trees are sorted
at once, in ranges, and read through once; a class without company of SHORTEST values in a tree leaves it
there.

Prefixes are matched at START values, the longest at which a pair at the similarity threshold meets in
some tree with probability RECALL. What a class meets there tells how much it may have missed: a
neighbour of estimated similarity s (from all values of both labels) is met with probability
p = 1 - (1 - s^d)^TREES at depth d, so the class's recall is the number of its neighbours over the sum of
1 / p. Class by class the prefix is shortened, to SHORTEST at least, until that recall reaches TARGET.

Sharing is kept as stars (each class to the lowest of its node), so a hot node costs its number of
rows. Connected parts of the stars are compared exactly. A part of more than BLOCK_ROWS classes is cut
into blocks, by the lowest class met and, where one has a great many, by a salt; a class is compared in
the pairs of blocks in which it shares a node, and in its own. A pair of blocks is one matrix product;
it returns counts of links and spanning stars, never pairs.

Result: a row a document with its class, copies, links (other documents of similarity 0.8 or more,
copies counted) and group (connected by links). Copies are not expanded into pairs; every pair of
classes that shares a node is compared.

Defined results: words are runs of letters, digits and underscores in lower case; a text of one to
four words has one shingle of all of them; texts without words are alike only if they are equal;
null counts as empty. doc_id identifies a document; rows without one are alone and stay; rows that
repeat one are copies of it, or of what they equal. The class and the group carry the lowest doc_id
among them, which settles ties. Whole texts are read, however long; an empty table gives none. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import cut, table

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
TREES, LABEL, SHORTEST, RECALL, TARGET = 32, 8, 5, 0.999, 0.9999
#: A neighbour counts as evidence from this estimated similarity on (the estimate's error is 0.025).
EVIDENCE = 0.75
BLOCK_ROWS, BLOCK_BYTES, COLUMNS, SALTS = 1024, 8 << 20, 2048, 8
WORD = re.compile(r"\w+")

_random = np.random.default_rng(20_260_101)
_MIX = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _random.integers(1, 1 << 31, TREES * LABEL, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, TREES * LABEL, dtype=np.uint32)


def finish(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values well spread."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, min(len(w), WORDS), dtype=np.uint64)
    for k in range(min(len(w), WORDS)):
        h += finish(w[k : k + n] * _MIX[k])
    return np.unique(finish(h))


def prefix_depth(trees: int = TREES, longest: int = LABEL, recall: float = RECALL, similarity: float = NUMERATOR / DENOMINATOR) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with the recall."""
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


START = max(SHORTEST, prefix_depth())


def labels(found: np.ndarray) -> np.ndarray:
    """Two 64-bit words a tree: its LABEL MinHash values of 16 bits, the first one highest."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(TREES * LABEL, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[None, at : at + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return low.astype(">u2").view(">i8").astype(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, class key, bytes of text, and labels of all trees (none for a text without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part, rows = b.iloc[at : at + 1000], []
                for text in part["text"]:
                    found = shingles(text)
                    raw = found.tobytes() if len(found) else b"text" + (text or "").encode()
                    rows.append((hashlib.blake2b(raw, digest_size=16).digest(), len(text or ""), labels(found) if len(found) else []))
                yield pd.DataFrame(rows, columns=["key", "size", "label"]).assign(doc_id=part["doc_id"].to_numpy())[["doc_id", "key", "size", "label"]]

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id bigint, key binary, size bigint, label array<bigint>")


def shared_values(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many leading 16-bit values are equal, given the differing bits of the two words of labels."""
    out = np.zeros(len(high), dtype=np.int64)
    going = np.ones(len(high), dtype=bool)
    for word in (high.view(np.uint64), low.view(np.uint64)):
        for k in range(3, -1, -1):
            going &= (word >> np.uint64(16 * k)) & np.uint64(0xFFFF) == 0
            out += going
    return out


def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (tree, high, low, doc_id) in order: those that share SHORTEST values or more with the row
    before or after, and how many. The first and last row of a range may have company in the next one
    and count as sharing all."""
    held, before = None, LABEL
    for b in batches:
        if not len(b):
            continue
        rows = b if held is None else pd.concat([held, b], ignore_index=True)
        tree, high, low = (rows[c].to_numpy(np.int64) for c in ("tree", "high", "low"))
        with_next = np.where(tree[1:] == tree[:-1], shared_values(high[1:] ^ high[:-1], low[1:] ^ low[:-1]), 0)
        with_last = np.concatenate([[before], with_next])
        best = np.maximum(with_last[:-1], with_next)
        keep = best >= SHORTEST
        if keep.any():
            yield rows.iloc[:-1][keep].assign(matched=best[keep])[["doc_id", "tree", "high", "low", "matched"]]
        held, before = rows.iloc[-1:], int(with_last[-1])
    if held is not None:
        yield held.assign(matched=LABEL)[["doc_id", "tree", "high", "low", "matched"]]


def branches(classes: DataFrame) -> DataFrame:
    """(doc_id, tree, high, low, matched): the classes' labels where they have company, from one pass
    over the sorted tries. Ranges end between any two rows, so a label that many classes share is no
    single task's."""
    tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.get("label", 2 * t).alias("high"), F.get("label", 2 * t + 1).alias("low")))
    order = ["tree", "high", "low", "doc_id"]
    leaves = classes.where(F.size("label") > 0).select(F.inline_outer(tree), "doc_id")
    return leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(matched, "doc_id bigint, tree int, high bigint, low bigint, matched bigint")


def at_depth(found: DataFrame, depth: int) -> DataFrame:
    """(doc_id, tree, node): the trie nodes of a depth (over four values) that classes stand in."""
    node = F.xxhash64("tree", F.lit(depth), "high", F.shiftright("low", 16 * (LABEL - depth)))
    return found.where(F.col("matched") >= depth).select("doc_id", "tree", node.alias("node"))


def hubs_of(members: DataFrame) -> DataFrame:
    """(node, hub): the lowest class of each node of two or more."""
    return members.groupBy("node").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("highest")).where("hub < highest").select("node", "hub")


def estimated(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal MinHash values of two labels."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.stack(s.to_list()).astype(np.int64).view(np.uint16) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def depths(classes: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, depth) of the classes whose prefix is shortened below START. met: (a, b), neighbours
    at START. Hubs that many classes met are salted."""
    label = classes.select(F.col("doc_id").alias("b"), F.col("label").alias("of_b"))
    of_hub = met.select("b").distinct().join(label, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = met.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(of_hub, ["b", "salt"])
    pairs = pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("label").alias("of_a")), "a")
    alike = cut(pairs.select("a", "b", F.pandas_udf(estimated, "double")("of_a", "of_b").alias("s"))).where(F.col("s") >= EVIDENCE)
    seen = alike.select(F.col("a").alias("doc_id"), "s").unionByName(alike.select(F.col("b").alias("doc_id"), "s"))
    missed = lambda d: F.sum(1 / (1 - F.pow(1 - F.pow("s", F.lit(d)), F.lit(TREES))))
    steps = range(START, SHORTEST, -1)
    told = seen.groupBy("doc_id").agg(F.count("*").alias("n"), *(missed(d).alias(f"sum_{d}") for d in steps))
    depth = F.lit(SHORTEST)
    for d in reversed(steps):
        depth = F.when(F.col("n") / F.col(f"sum_{d}") >= TARGET, d).otherwise(depth)
    return told.select("doc_id", depth.alias("depth")).where(F.col("depth") < START)


def nodes(classes: DataFrame) -> DataFrame:
    """(doc_id, node, hub): the nodes in which classes meet, each class at its own depth. In a tree a class
    is told with its shallowest node only, which holds all that share deeper ones with it."""
    found = cut(branches(classes))
    members = at_depth(found, START)
    first = cut(members.join(hubs_of(members), "node").select("doc_id", "tree", F.lit(START).alias("depth"), "node", "hub"))
    short = cut(depths(classes, first.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()))
    out = first
    for d in range(START - 1, SHORTEST - 1, -1):
        wide = at_depth(found, d)
        asked = wide.join(short.where(F.col("depth") <= d).select("doc_id"), "doc_id", "left_semi").select("node").distinct()
        wide = wide.join(asked, "node", "left_semi")
        out = out.unionByName(wide.join(hubs_of(wide), "node").select("doc_id", "tree", F.lit(d).alias("depth"), "node", "hub"))
    return out.groupBy("doc_id", "tree").agg(F.min(F.struct("depth", "node", "hub")).alias("n")).select("doc_id", "n.node", "n.hub")


def same_edges(a: DataFrame) -> tuple:
    return tuple(a.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the lowest node of the connected part.
    Alternating large-star and small-star steps; sums and joins only, one table written a round."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = same_edges(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after = same_edges(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def linked(rows: list[np.ndarray], cols: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of exact links between shingle sets: of `rows` among themselves, or with `cols`."""
    sets = rows if cols is None else rows + cols
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a shingle of one set meets no other
    column, owner = column[keep], owner[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n = len(rows)
    left, right = (0, n), (0, n) if cols is None else (n, len(sets))
    meet = np.zeros((n, right[1] - right[0]), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        meet += x[left[0] : left[1]] @ x[right[0] : right[1]].T
    union = sizes[:n, None] + sizes[None, right[0] : right[1]] - meet
    link = DENOMINATOR * meet >= NUMERATOR * union
    if cols is None:
        np.fill_diagonal(link, False)
    return link


def roots_of(link: np.ndarray, names: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix, the lowest name of their connected part of it."""
    r, c = names.copy(), others.copy()
    top = np.iinfo(np.int64).max
    while True:
        r2 = np.minimum(r, np.where(link, c[None, :], top).min(axis=1, initial=top))
        c2 = np.minimum(c, np.where(link, r2[:, None], top).min(axis=0, initial=top))
        if (r2 == r).all() and (c2 == c).all():
            return r, c
        r, c = r2, c2


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block pair (part, i, j): links of each class in it, and the star it falls in."""

    def ended(held: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(held)
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        sets = [shingles(t) for t in g["text"]]
        names, copies = g["doc_id"].to_numpy(np.int64), g["copies"].to_numpy(np.int64)
        if i == j:
            link = linked(sets)
            r, _ = roots_of(link, names, names)
            return pd.DataFrame({"doc_id": names, "links": link @ copies, "root": r})
        first = (g["block"] == i).to_numpy()
        if first.all() or not first.any():
            return pd.DataFrame({"doc_id": names, "links": 0, "root": names})
        link = linked([s for s, f in zip(sets, first) if f], [s for s, f in zip(sets, first) if not f])
        r, c = roots_of(link, names[first], names[~first])
        a = pd.DataFrame({"doc_id": names[first], "links": link @ copies[~first], "root": r})
        return pd.concat([a, pd.DataFrame({"doc_id": names[~first], "links": copies[first] @ link, "root": c})])

    now, held, done, rows = None, [], [], 0
    for b in batches:
        keys = list(zip(b["part"], b["i"], b["j"]))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for s, t in zip(starts, starts[1:]):
            if s == t:
                continue
            if keys[s] != now and held:
                done.append(ended(held))
                rows, held = rows + len(done[-1]), []
            now = keys[s]
            held.append(b.iloc[s:t])
            if rows > 5000:
                yield pd.concat(done)
                done, rows = [], 0
    if held:
        done.append(ended(held))
    if done:
        yield pd.concat(done)


def dealt(members: DataFrame, shares: DataFrame) -> DataFrame:
    """doc_id, part, copies, block, i, j: the pairs of blocks (i <= j) in which a class is compared.
    members: doc_id, part, copies, size; shares: doc_id, node, hub."""
    cells = lambda rows, bytes_, by: F.greatest(F.ceil(rows / (BLOCK_ROWS / by)), F.ceil(bytes_ / (BLOCK_BYTES / by)), F.lit(1)).cast("int")
    homes = shares.groupBy("doc_id").agg(F.min("hub").alias("home"))
    sizes = members.groupBy("part").agg(cells(F.count("*"), F.sum("size"), 1).alias("blocks"))
    known = members.join(homes, "doc_id").join(sizes, "part")
    single = known.where("blocks = 1").select("doc_id", "part", "copies", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    many = known.where("blocks > 1")
    pieces = many.groupBy("home").agg(cells(F.count("*"), F.sum("size"), 4).alias("pieces"))
    block = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))), F.col("blocks")).cast("int")
    many = cut(many.join(pieces, "home").select("doc_id", "part", "copies", block.alias("block")))
    placed = shares.select("doc_id", "node").join(many.select("doc_id", "block"), "doc_id")
    met = placed.join(placed.select("node", F.col("block").alias("other")).distinct(), "node").select("doc_id", "other")
    met = met.unionByName(many.select("doc_id", F.col("block").alias("other"))).distinct().join(many, "doc_id")
    return single.unionByName(met.select("doc_id", "part", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copies, links and group_id of every row with a doc_id."""
    rows = cut(signed(docs))
    classes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.any_value("label").alias("label")))
    shares = cut(nodes(classes))
    parts = components(shares.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("part"))
    members = cut(classes.select("doc_id", "copies", "size").join(parts, "doc_id"))
    texts = docs.select("doc_id", "text").join(members.select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    work = dealt(members, shares).join(texts, "doc_id").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
    seen = cut(work.select("doc_id", "part", "copies", "block", "i", "j", "text").mapInPandas(compare, "doc_id bigint, links bigint, root bigint"))
    links = seen.groupBy("doc_id").agg(F.sum("links").alias("links"))
    tops = components(seen.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))
    known = classes.select("key", "doc_id", "copies").join(links, "doc_id", "left").join(tops, "doc_id", "left")
    known = known.select("key", F.col("doc_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "doc_id").alias("group_id"))
    return rows.select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "group_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document of the lowest doc_id stays; rows without an id stay."""
    found = groups(docs)
    lose = found.where(F.col("doc_id") != F.col("group_id")).select("doc_id")
    kept = docs.join(lose, "doc_id", "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").take(1):
        named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where(F.col("doc_id").isNull()))
    return kept.select(*docs.columns)
