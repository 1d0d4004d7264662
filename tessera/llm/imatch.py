"""I-Match fingerprints, in DataFrame functions only.

Terms are counted over all distinct texts, a text with copies once; the lexicon keeps those whose inverse document frequency lies
in a band. A document's distinct lexicon terms are sorted and hashed, for the whole lexicon and for
several randomised subsets of it: REPLICAS random draws, each nested in LEVELS halvings, so that long
and short texts both have subsets that hold few of their terms. The fingerprint is the row of those
hashes; the likeness of two is the share of equal ones among the subsets that hold a term of either.

The band's lower document frequency, as a share of the distinct texts, bounds the lexicon: at most
(distinct terms a text) / MIN_SHARE terms reach it, however many texts there are. So the hashes of
its terms go with the plan, as one table of 2^CELLS cells, each a text of the hashes that begin alike;
a term is in the lexicon if its cell holds its hash, and no other term passes.

The edited text of the contract takes text of the next document by descending doc_id. Ids are dealt
by their quantiles, and again by quantiles within those, in as many parts as the rows need at PART_ROWS
each; neighbours then stand in one window, and the first row of each part is also dealt to the part
before; no window spans all rows.

Defined results: terms are runs of letters and digits in lower case; null text counts as empty; a text
without lexicon terms has the fingerprint of the empty set, like only to itself (1 or 0); rows without
an id come last; rows that share an id are ordered by text; the only row of a table is its own next;
an empty table gives none. Whole texts are read, however long. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, table

MIN_SHARE, MAX_SHARE, LEAST = 0.0005, 0.1, 2
REPLICAS, LEVELS = 6, 10
CELLS, PART_ROWS, SIDE, BROADCAST_ROWS = 16, 1000, 1000, 500_000


def words(text: Column) -> Column:
    """Distinct terms' hashes, unsorted."""
    found = F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w)))


def in_band(df: Column, n: int) -> Column:
    """Whether a document frequency among n texts lies in the band."""
    return (df >= max(LEAST, MIN_SHARE * n)) & (df <= max(LEAST, MAX_SHARE * n))


def lexicon(docs: DataFrame) -> DataFrame:
    """Hashes of the terms in the band, over distinct texts: each of a text's copies counts as its share
    of one, so copies do not push their own terms out and no text is moved to meet them. Texts are told
    apart by hash and length. Those that have copies go to every task if there are few enough of them,
    else the texts' terms are moved to meet them."""
    key = [F.xxhash64("text").alias("hash"), F.length("text").alias("n")]
    texts = cut(docs.select(*key).groupBy("hash", "n").agg(F.count("*").alias("copies")))
    copied = texts.where("copies > 1")
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    # outer, as for an inner explode Spark tests size(terms) at the scan, which works terms out twice
    found = docs.select(*key, words(F.col("text")).alias("terms")).join(copied, ["hash", "n"], "left")
    found = found.select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode_outer("terms").alias("term"))
    counts = found.groupBy("term").agg(F.round(F.sum(1 / F.col("copies"))).alias("df"))
    return counts.where(F.col("term").isNotNull() & in_band(F.col("df"), texts.count())).select("term")


def spelled_term(term: Column) -> Column:
    """A term's hash as 16 characters: its sign bit is set, so none is shorter."""
    return F.hex(term.bitwiseOR(F.lit(-(1 << 63))))


def cell(term: Column) -> Column:
    """The cell of a term: the CELLS bits after the sign bit."""
    return F.shiftright(term, 63 - CELLS).bitwiseAND(F.lit((1 << CELLS) - 1)).cast("int")


def term_table(terms: DataFrame) -> Column:
    """The lexicon as an array of 2^CELLS texts, the hashes of each cell in a row. Executors write the
    cells, the driver puts them in order; Spark splits the one text when it plans."""
    held = terms.groupBy(cell(F.col("term")).alias("cell")).agg(F.array_join(F.array_sort(F.collect_list(spelled_term(F.col("term")))), "").alias("hashes"))
    out = [""] * (1 << CELLS)
    for row in held.toLocalIterator():
        out[row["cell"]] = row["hashes"]
    return F.split(F.lit(",".join(out)), ",")


def within(term: Column, table_: Column) -> Column:
    """Whether a term's cell holds its hash."""
    return F.contains(F.get(table_, cell(term)), spelled_term(term))


def band_terms(text: Column, table_: Column) -> Column:
    return F.array_sort(F.filter(words(text), lambda t: within(t, table_)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def subset_hashes(terms: Column) -> Column:
    """Hashes of the sorted terms in the lexicon and in each randomised subset; 0 for an empty one.
    Subset `level` of a replica keeps the terms of the one above whose next hash bit is 0."""

    def hashed(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.hash(a)).otherwise(F.lit(0))

    def halved(a: Column, bit: int) -> Column:
        return F.filter(a, lambda t: F.getbit(t, F.lit(bit)) == 0)

    def below(a: Column, replica: int, level: int) -> Column:
        if level + 1 == LEVELS:
            return F.array(hashed(a))
        return F.concat(F.array(hashed(a)), once(halved(a, LEVELS * replica + level + 1), lambda b: below(b, replica, level + 1)))

    return F.concat(F.array(hashed(terms)), *(once(halved(terms, LEVELS * r), lambda b: below(b, r, 0)) for r in range(REPLICAS)))


def fingerprint(text: Column, table_: Column) -> Column:
    """Row of subset hashes of a text; the sorted terms are worked out once."""
    return once(band_terms(text, table_), subset_hashes)


def spelled(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text."""
    state = F.struct(F.lit(0).alias("same"), F.lit(0).alias("held"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(((x == y) & (x != 0)).cast("int").alias("same"), ((x != 0) | (y != 0)).cast("int").alias("held")))
    add = lambda s, p: F.struct((s["same"] + p["same"]).alias("same"), (s["held"] + p["held"]).alias("held"))
    done = lambda s: F.when(s["held"] == 0, F.lit(1.0)).otherwise(s["same"] / s["held"])
    return F.aggregate(pairs, state, add, done)


def literal(values: list, kind: str) -> Column:
    """A list as one literal, read when Spark plans."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def quantiles(ids: DataFrame, side: int) -> list[list[int]]:
    """Bounds of `_id` in up to `side` parts; then, for each of these, its bounds in up to `side` again."""
    if side == 1:
        return [[], []]
    split = F.percentile_approx("_id", [k / side for k in range(1, side)], 20_000)
    outer = sorted(set(ids.agg(split).first()[0] or []))
    part = below(literal(outer, "array<bigint>"), F.col("_id")).alias("part")
    inner = {r["part"]: sorted(set(r["at"])) for r in ids.groupBy(part).agg(split.alias("at")).toLocalIterator()}
    return [outer, *(inner.get(k, []) for k in range(len(outer) + 1))]


def below(bounds: Column, value: Column) -> Column:
    """How many bounds are not above a value."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def beside_next(rows: DataFrame, columns: list[str], then: Callable[[DataFrame], DataFrame], part_rows: int | None = None) -> DataFrame:
    """`then(rows)` with next_<c> of the row that follows by descending doc_id; the first follows the last.
    `then` adds columns that are worked out where the rows stand beside each other, and so not moved.
    Parts hold ids between two quantiles, in two steps of up to SIDE, so that none is large: about
    `part_rows` rows, and from SIDE * SIDE * `part_rows` rows on the SIDE^2-th part of all."""
    keyed = rows.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ids = keyed.select("_id")
    side = max(1, min(SIDE, math.ceil(math.sqrt(ids.count() / (part_rows or PART_ROWS)))))
    outer, *inner = quantiles(ids, side)
    first = below(literal(outer, "array<bigint>"), F.col("_id"))
    keyed = keyed.withColumn("_part", first * side + below(F.get(literal(inner, "array<array<bigint>>"), first), F.col("_id")))
    tops = [(r["_part"], r["top"]) for r in keyed.groupBy("_part").agg(F.max("_id").alias("top")).orderBy(F.desc("_part")).toLocalIterator()]
    if not tops:
        return then(rows).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    # the top rows of a part follow the last row of the part above it; those of the highest follow the lowest
    top, above = [None] * (side * side + 1), [None] * (side * side + 1)
    for k, (part, highest) in enumerate(tops):
        top[part], above[part] = highest, tops[k - 1][0]
    is_top = F.get(literal(top, "array<bigint>"), F.col("_part")) == F.col("_id")
    home, guest = F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest")), F.struct(F.get(literal(above, "array<int>"), F.col("_part")).alias("part"), F.lit(1).alias("guest"))
    dealt = keyed.withColumn("_home", F.explode(F.when(is_top, F.array(home, guest)).otherwise(F.array(home))))
    dealt = then(dealt.select(*rows.columns, "_id", F.col("_home.part").alias("_part"), F.col("_home.guest").alias("_guest")).repartition("_part"))
    w = Window.partitionBy("_part").orderBy("_guest", F.desc("_id"), *(F.col(c) for c in columns[:1]))
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    return dealt.select("*", *nexts).where("_guest = 0").drop("_id", "_part", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns for doc_id and text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table_ = term_table(lexicon(base))
    marked = beside_next(base, ["text", "fp"], lambda rows: rows.withColumn("fp", fingerprint(F.col("text"), table_)))
    n = F.length("text")
    keep = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - keep), F.substr("next_text", F.lit(1), keep))
    marked = marked.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    marked = marked.withColumn("edited_fp", fingerprint(F.col("edited"), table_))
    return marked.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("fp")).alias("fingerprint"),
        spelled(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
