"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become sequences of tokens. A token is a number, a unit after a number, a name (a run of
capitalised words, wherever it stands) or a word; the first three give way to typed placeholders.
Whatever stands between tokens (blanks, line ends, tabs, quotes, brackets, hyphens, control
characters) separates them and has no other meaning, but a mark of punctuation ends a name. Windows of
WINDOW tokens of every benchmark item are hashed and joined with those of every document; a question
with other numbers, names or units still meets its template. A hit must then be consistent in its
slots: aligned at one offset, a value of the item stands for one value of the document and the other
way round; windows that hold a clashing slot do not count, unless they are equal word for word.

Beside the typed windows, all raw words of every item, in lower case, have windows too; these meet
verbatim copies however they are capitalised, and items of names and numbers alone. Typed windows of
which under half is literal would meet too much as templates and are left to the raw ones.

A document leaks an item if consistent typed windows cover at least SHARE of the item's literal
windows or RUN of them, or raw windows cover SHARE of all or RUN of them.

The benchmark's window hashes go to every task as a broadcast only when their number is counted and
within BROADCAST_ROWS; above it the join shuffles, with both sides salted, as one window may be in a
third of all documents. Documents' windows travel as (row, place, hash); tokens are read again, once, for
rows with a hit.

Defined results: null text counts as empty; items of under WINDOW tokens have one window of all their
tokens, which meets document windows of that length; an item of under SHORTEST raw words is leaked
by the documents whose words are exactly the item's, as it would hit others by chance; items without
words are leaked by none; repeated items and rows each report; rows without doc_id are clean and stay.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, table

#: A run of RUN windows (13 tokens) is a leak as well, however long the item.
WINDOW, SHORTEST, SHARE, RUN = 8, 5, 0.5, 6
BROADCAST_ROWS, SALTS = 200_000, 16
#: Units of measure that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds ml l liter liters litre litres gal gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degrees watt watts volts joules newtons"
).split()
#: Placeholders: private characters, which texts lose before they are typed.
NUM, UNIT, NAME = "\ue000", "\ue001", "\ue002"
PLACEHOLDERS = NUM + UNIT + NAME
#: Patterns: a number; a unit, where a number stands before it; a run of capitalised words; a word.
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*+"
GAP = r"[\s\p{Cc}\u00a0-]{0,3}"
A_UNIT = "(?i:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}_])"
CAPITAL = r"\p{Lu}(?<![\p{L}_]\p{Lu})[\p{L}_]*"
RUN_OF = rf"{CAPITAL}(?:[\s\p{{Cc}}'\u2019-]+{CAPITAL})*+"
WORD = r"[\p{L}_]+"


def plain(text: Column) -> Column:
    """The text, null as empty, without placeholders; the one capital whose lower case is two characters gives way."""
    return F.translate(F.coalesce(text, F.lit("")), PLACEHOLDERS + "\u0130", "   I")


def typed_tokens(text: Column) -> Column:
    """Tokens with placeholders for slots, lower case for the rest. Whole-text replacements, so no
    function runs a token at a time."""
    t = F.regexp_replace(F.regexp_replace(text, NUMBER, f" {NUM} "), f"{NUM} {GAP}{A_UNIT}", f"{NUM} {UNIT} ")
    t = F.regexp_replace(t, RUN_OF, f" {NAME} ")
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}_{PLACEHOLDERS}]+"), "")


def raw_tokens(text: Column) -> Column:
    """What stands in the text for each typed token, in lower case; a name's words by one blank."""
    found = F.regexp_extract_all(text, F.lit(rf"{NUMBER}|(?<=\p{{Nd}}{GAP}){A_UNIT}|{RUN_OF}|{WORD}"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"[\s\p{Cc}'\u2019-]+", " "))


def raw_words(text: Column) -> Column:
    """All words and numbers, in lower case, names not gathered."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), "")


def window_hashes(words: Column, sizes: list[int], kind: str) -> Column:
    """Hashes of the windows of each size in turn. Each word is hashed once, with the kind; hashes of
    2, 4 and 8 words come from two hashes half as long, those of other sizes from the longest of these
    and the words after it. So no hash serves two kinds or sizes, but by chance."""

    def joined(a: Column, b: Column, by: int) -> Column:
        """Hashes of a's windows, each followed by b's window `by` places on, as far as there is one."""
        return F.zip_with(F.slice(a, 1, left(b, by)), F.slice(b, by + 1, left(b, by)), lambda x, y: F.xxhash64(x, y))

    def left(a: Column, by: int) -> Column:
        return F.greatest(F.size(a) - by, F.lit(0))

    def level(one: Column, own: Column, size: int) -> Column:
        """Those of all sizes from `size` on; `own` are the hashes of windows of `size` words."""
        out = [own] if size in sizes else []
        for more in (s for s in sizes if size < s < 2 * size):
            longer = own
            for by in range(size, more):
                longer = joined(longer, one, by)
            out.append(longer)
        if max(sizes) >= 2 * size:
            out.append(once(joined(own, own, size), lambda up: level(one, up, 2 * size)))
        return out[0] if len(out) == 1 else F.concat(*out)

    return once(F.transform(words, lambda w: F.xxhash64(w, F.lit(kind))), lambda one: level(one, one, 1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def found(sizes: dict[str, list[int]]) -> Column:
    """Hashes of the windows of a text with columns typed and raw: typed and raw ones of the sizes that
    the benchmark has, and all words of a text that is as short as its shortest items."""
    parts = [window_hashes(F.col(kind), sizes[kind], kind) for kind in ("typed", "raw") if sizes[kind]]
    for size in sizes["whole"]:
        parts.append(F.when(F.size("raw") == size, window_hashes(F.col("raw"), [size], "whole")).otherwise(F.array().cast("array<bigint>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def place(sizes: dict[str, list[int]]) -> Column:
    """The word at which a window begins, from its position `pos` among the text's hashes, its kind and
    size, and the text's numbers of tokens n_typed and n_raw."""
    before, at = F.lit(0), F.lit(None)
    for kind in ("typed", "raw", "whole"):
        n = F.col("n_typed" if kind == "typed" else "n_raw")
        for size in sizes[kind]:
            at = F.when((F.col("kind") == kind) & (F.col("size") == size), F.col("pos") - before).otherwise(at)
            count = F.greatest(n - (size - 1), F.lit(0)) if kind != "whole" else (n == size).cast("int")
            before = before + count
    return at


def item_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens as typed and as said, raw words; items without words go."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", plain(F.col("text")).alias("text")).distinct()
    rows = rows.select("item_id", F.xxhash64("text").alias("of_item"), typed_tokens(F.col("text")).alias("typed"), raw_tokens(F.col("text")).alias("said"), raw_words(F.col("text")).alias("raw"))
    return rows.where(F.size("raw") > 0)


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the benchmark: item, kind, size, item_at, hash, and how many of the kind the item has.
    Typed windows of which under half is literal go."""
    pieces = []
    for kind, words in (("typed", "typed"), ("raw", "raw"), ("whole", "raw")):
        for size in range(1, SHORTEST) if kind == "whole" else range(SHORTEST, WINDOW + 1):
            of = items.where(F.size(words) == size if size < WINDOW else F.size(words) >= size)
            pieces.append(of.select(*ITEM, "typed", F.lit(kind).alias("kind"), F.lit(size).alias("size"), F.posexplode(window_hashes(F.col(words), [size], kind)).alias("item_at", "hash")))
    made = reduce(DataFrame.unionByName, pieces)
    literal = F.size(F.filter(F.slice("typed", F.col("item_at") + 1, F.col("size")), lambda t: ~t.isin(NUM, NAME, UNIT)))
    made = made.where((F.col("kind") != "typed") | (literal * 2 >= F.col("size"))).drop("typed")
    return made.withColumn("n_windows", F.count("*").over(Window.partitionBy(*ITEM, "kind")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text (rows may share a doc_id) and the text to type, of rows with an id."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("of_text"), plain(F.col("text")).alias("text"))


#: What tells a document from others, an item from others, an alignment of the two from others.
ROW, ITEM = ["doc_id", "of_text"], ["item_id", "of_item"]
ALIGNED = [*ROW, *ITEM, "kind", "shift"]


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """A row an alignment: document, item, kind, shift of the document's places against the item's, and
    the item's windows `ats` whose hashes meet the document's."""
    sizes: dict[str, list[int]] = {"typed": [], "raw": [], "whole": []}
    for r in windows.select("kind", "size").distinct().orderBy("kind", "size").collect():
        sizes[r["kind"]].append(r["size"])
    if not any(sizes.values()):
        sizes["raw"] = [WINDOW]
    read = docs.select(*ROW, typed_tokens(F.col("text")).alias("typed"), raw_words(F.col("text")).alias("raw"))
    read = read.select(*ROW, F.size("typed").alias("n_typed"), F.size("raw").alias("n_raw"), found(sizes).alias("hashes"))
    # outer, as for an inner one Spark tests size(hashes) at the scan, which works everything out twice
    seen = read.select(*ROW, "n_typed", "n_raw", F.posexplode_outer("hashes").alias("pos", "hash"))
    if windows.count() <= BROADCAST_ROWS:
        met = seen.join(F.broadcast(windows), "hash")
    else:
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    met = met.withColumn("shift", place(sizes) - F.col("item_at"))
    return met.groupBy(*ALIGNED).agg(F.array_sort(F.collect_set("item_at")).alias("ats"), F.max("size").alias("size"), F.max("n_windows").alias("n_windows"))


def compared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments with the item's slots (place, kind, value, the document's value), the windows that are
    equal word for word (same), and those equal outside the slots (fit). Tokens are read again for documents with a hit."""
    met = cut(hits(docs, cut(item_windows(items))))
    held = cut(met.select(*ROW).distinct())
    words = docs.join(F.broadcast(held) if held.count() <= BROADCAST_ROWS else held, ROW, "left_semi").dropDuplicates(ROW)
    words = cut(words.select(*ROW, raw_tokens(F.col("text")).alias("doc_said"), raw_words(F.col("text")).alias("doc_raw")))
    near = met.join(words, ROW).join(items, ITEM)
    typed = F.col("kind") == "typed"
    other = F.transform(F.when(typed, F.col("said")).otherwise(F.col("raw")), lambda w, k: F.get(F.when(typed, F.col("doc_said")).otherwise(F.col("doc_raw")), k + F.col("shift")))
    near = near.select(*ALIGNED, "ats", "size", "n_windows", "typed", F.when(typed, F.col("said")).otherwise(F.col("raw")).alias("own"), other.alias("other"))
    slot = lambda t: F.coalesce(t.isin(NUM, NAME, UNIT), F.lit(False))
    cell = F.zip_with("own", "other", lambda a, b: F.struct(a.alias("item"), b.alias("doc"), F.coalesce(a == b, F.lit(False)).alias("same")))
    cell = F.transform(cell, lambda c, k: F.struct(k.alias("place"), F.when(typed, F.get("typed", k)).alias("kind"), c["item"].alias("item"), c["doc"].alias("doc"), c["same"].alias("same"), (c["same"] | (slot(F.when(typed, F.get("typed", k))) & c["doc"].isNotNull())).alias("fit")))
    near = cut(near.select(*ALIGNED, "ats", "size", "n_windows", cell.alias("cells")))
    inside = lambda at, field: F.forall(F.sequence(at, at + F.col("size") - 1), lambda k: F.get("cells", k)[field])
    near = near.withColumns({"same": F.filter("ats", lambda at: inside(at, "same")), "fit": F.filter("ats", lambda at: inside(at, "fit"))})
    slots = F.filter("cells", lambda c: slot(c["kind"]) & F.exists("fit", lambda at: (at <= c["place"]) & (c["place"] < at + F.col("size"))))
    return near.select(*ALIGNED, "size", "n_windows", "same", F.array_except("fit", "same").alias("changed"), slots.alias("slots"))


def clashes(near: DataFrame) -> DataFrame:
    """Alignments with the places of clashing slots. In an alignment, a value of the item stands for the
    value of the document that most of its places show, and the other way round; other values clash,
    and all of them where none shows most often. Alignments without a changed window are not asked."""
    pair = [*ALIGNED, "slot", "item", "doc"]
    said = near.where(F.size("changed") > 0).select(*ALIGNED, F.explode("slots").alias("s"))
    said = said.select(*ALIGNED, "s.place", F.col("s.kind").alias("slot"), "s.item", "s.doc").groupBy(*pair).agg(F.collect_set("place").alias("places"))

    def leads(side: str) -> Column:
        by = Window.partitionBy(*ALIGNED, "slot", side)
        return F.rank().over(by.orderBy(F.size("places"))) == F.count("*").over(by)

    said = said.withColumns({"by_item": leads("item"), "by_doc": leads("doc")}).where(~(F.col("by_item") & F.col("by_doc")))
    return said.groupBy(*ALIGNED).agg(F.flatten(F.collect_list("places")).alias("bad"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, of_text, item_id, covered, changed): documents that hold an item, or one with other
    numbers, names or units (changed). of_text is the hash of the document's text."""
    near = cut(compared(keyed(docs), cut(item_tokens(benchmark))))
    near = near.join(clashes(near), ALIGNED, "left")
    clear = lambda at: ~F.exists("bad", lambda k: (at <= k) & (k < at + F.col("size")))
    n = F.size("same") + F.when(F.col("bad").isNull(), F.size("changed")).otherwise(F.size(F.filter("changed", clear)))
    runs = near.select(*ALIGNED, n.alias("n"), "n_windows")
    good = runs.where((F.col("n") / F.col("n_windows") >= SHARE) | (F.col("n") >= RUN))
    return good.groupBy(*ROW, "item_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("covered"), F.min(F.col("kind") == "typed").alias("changed"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: whether it leaks, the items, the largest share of one that is covered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    by_row = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy(*ROW).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"))
    joined = docs.select("doc_id", F.xxhash64("text").alias("of_text")).join(by_row, ROW, "left")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("leaked"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak an item go."""
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked_id"), F.col("of_text").alias("leaked_text")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["leaked_id"]) & (F.xxhash64(docs["text"]) == bad["leaked_text"]), "left_anti").select(*docs.columns)
