"""Token counts by a compiled transducer.

A piece vocabulary with merge scores is compiled into a deterministic transducer over characters.
Its state is what the segmentation of the text read so far still leaves open: for each place where
a piece may be under way, the piece that ended there, the vocabulary node reached since, and the
count of pieces up to there, relative to now. A transition carries the change of the count. Of two
neighbouring pieces it need only be known whether merging their joint text gives the two again;
given that for all neighbours, the segmentation of the whole is theirs, so the last piece of every
prefix is found without looking ahead. States are made as texts ask for them.

Where no piece holds two characters in a row, the transducer forgets: reading the second one it
goes on from the start. Between two such places lies a word. The map of a chunk of text is therefore
short: what it does before its first such place depends on the state it is entered in, everything
after does not. Maps compose associatively; a parallel prefix scan over the chunks of a text gives
the count up to each chunk, and of the whole.

Defined results: a null text counts as empty and has no tokens; an unknown character counts its
UTF-8 bytes if the vocabulary has byte pieces, else 1 for each run of them. Files ending in .json are
counted by the tokenizers library's own automaton through `count_library`. Whole texts are read, however
long: time grows with the length times the logarithm of the number of chunks. Rows that repeat each give a
row, an empty table none; the count takes the place of a column of its name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.pieces import BYTE, SPACE, Model, Normalizer, default_model, parse_model
from tessera.llm.shared import table

LIMIT = 4096
CHUNK = 1 << 15
#: Bounds of what a worker remembers; when one is full it starts anew, with the same results.
STATES, WORDS_KEPT = 250_000, 200_000

#: A state: (piece that ended there, node reached since, count there minus count now) by open place.
State = tuple[tuple[int, int, int], ...]
NONE, FOREIGN = -1, -2


class Transducer:
    """The compiled vocabulary of one model."""

    def __init__(self, model: Model) -> None:
        self.texts = [p for p, _, _ in model.pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (1, 4)}
        self.scores = {p: s for p, s, kind in model.pieces if kind in (1, 4)}
        self.bytes = any(kind == BYTE for _, _, kind in model.pieces)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [NONE]
        self.pairs: set[str] = set()
        for p, i in self.ids.items():
            node = 0
            for c in p:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(NONE)
                node = self.children[node][c]
            self.ends[node] = i
            self.pairs.update(map("".join, zip(p, p[1:])))
        #: A state's moves: character -> (moves of the next state, change of the count); None -> the state.
        self.start: dict = {None: ((NONE, 0, 0),)}
        self.states: dict[State, dict] = {self.start[None]: self.start}
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: the best-scored, then leftmost, pair merges first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best = max(((scores.get(a + b, -1e30), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] <= -1e30:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b may stand after piece a (or at the start, or after a foreign character)."""
        found = self.fits.get((a, b))
        if found is None:
            left = [self.texts[a]] if a >= 0 else []
            found = self.fits[a, b] = self.merged("".join(left) + self.texts[b]) == [*left, self.texts[b]]
        return found

    def forgets(self, last: int, c: str) -> bool:
        """No piece holds the last character read and c in a row."""
        return last == FOREIGN or last >= 0 and self.texts[last][-1] + c not in self.pairs

    def move(self, at: dict, c: str) -> tuple[dict, int]:
        """(moves of the next state, change of the count) for a character, made at first use."""
        if len(self.states) > STATES:
            raise MemoryError
        nodes, kept, here, state = self.children, [], None, at[None]
        ended = state[-1][0]
        if self.forgets(ended, c):
            state = self.start[None]
        for last, node, rel in state:
            go = nodes[node].get(c)
            if go is None:
                continue
            kept.append((last, go, rel))
            end = self.ends[go]
            if end != NONE and here is None and self.fit(last, end):
                here = (end, rel + 1)
        if here is None:  # a character of no piece: its bytes stand by themselves
            to: State = ((FOREIGN, 0, 0),)
            change = len(c.encode()) if self.bytes else int(ended != FOREIGN)
        else:
            last, change = here
            to = (*((a, n, r - change) for a, n, r in kept if nodes[n]), (last, 0, 0))
        at[c] = made = self.states.setdefault(to, {None: to}), change
        return made

    def run(self, text: str, at: dict | None = None) -> tuple[dict, int]:
        """(state, tokens added) after reading `text` in state `at`, or from the start."""
        count = 0
        if at is None:
            at = self.start
        for c in text:
            step = at.get(c)
            at, change = step if step else self.move(at, c)
            count += change
        return at, count


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state: `head` is read in the entering state; then, if `sealed`, `count`
    tokens follow whatever came before, and the chunk is left in `state`."""

    head: str
    sealed: bool
    count: int = 0
    state: dict | None = None


class Counter:
    """Counts of one model; `counter` keeps one a worker process."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.normalizer = Normalizer(self.model)
        m = self.model
        self.apart = m.words_apart
        self.simple = m.escape and self.apart and not (m.charsmap or m.remove_extra or m.suffix or self.normalizer.own)
        self.transducer = Transducer(m)
        self.words: dict[str, int] = {}
        self.marked = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def word(self, chunk: str) -> int:
        """Tokens of a word, read from the start state: a path of transitions kept as one."""
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        try:
            found = self.transducer.run(chunk)[1]
        except MemoryError:
            self.transducer = Transducer(self.model)
            found = self.transducer.run(chunk)[1]
        self.words[chunk] = found
        return found

    def forgets_at(self, chunk: str, k: int) -> bool:
        """Whether, in whatever state the chunk is entered, the transducer goes on from the start at k."""
        t = self.transducer
        return chunk[k - 1 : k + 1] not in t.pairs and chunk[k] in t.children[0]

    def chunk_map(self, chunk: str) -> ChunkMap:
        """Map of a chunk whose neighbours are unknown."""
        first = next((k for k in range(1, len(chunk)) if self.forgets_at(chunk, k)), 0)
        if not first:
            return ChunkMap(chunk, False)
        last = next(k for k in range(len(chunk) - 1, 0, -1) if self.forgets_at(chunk, k))
        count, get, inside = 0, self.words.get, chunk[first:last]
        if self.apart:
            for w in self.marked.findall(inside):
                n = get(w)
                count += self.word(w) if n is None else n
        else:
            count = self.transducer.run(inside)[1]
        state, more = self.transducer.run(chunk[last:])
        return ChunkMap(chunk[:first], True, count + more, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of chunk a followed by chunk b."""
        if not a.sealed:
            return ChunkMap(a.head + b.head, b.sealed, b.count, b.state)
        state, more = self.transducer.run(b.head, a.state)
        if b.sealed:
            return ChunkMap(a.head, True, a.count + more + b.count, b.state)
        return ChunkMap(a.head, True, a.count + more, state)

    def enter(self, m: ChunkMap) -> int:
        """Tokens when a map is entered in the start state."""
        return self.transducer.run(m.head)[1] + m.count

    def prefix_counts(self, text: str, size: int = CHUNK) -> list[int]:
        """Tokens of the normalised text up to the end of each chunk. The maps of all prefixes from the
        first sealed one on have the same head, which is entered once; before that, a prefix goes on
        where the one before it ended."""
        chunks = [text[k : k + size] for k in range(0, len(text), size)]
        out, at, head = [], None, None
        for chunk, m in zip(chunks, scan([self.chunk_map(c) for c in chunks], self.compose)):
            if m.sealed:
                head = self.transducer.run(m.head)[1] if head is None else head
                out.append(head + m.count)
            else:
                at, more = self.transducer.run(chunk, at)
                out.append(more + (out[-1] if out else 0))
        return out

    def total(self, text: str, size: int = CHUNK) -> int:
        """Tokens of the normalised text: neighbouring maps composed in rounds, the last one entered."""
        maps = [self.chunk_map(text[k : k + size]) for k in range(0, len(text), size)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return self.enter(maps[0]) if maps else 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.simple and len(text) <= CHUNK and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            get, own, total = self.words.get, self.word, 0
            body = (SPACE + text.replace(" ", f" {SPACE}")) if self.model.dummy_prefix else text.replace(" ", f" {SPACE}")
            for w in body.split(" "):
                n = get(w)
                total += own(w) if n is None else n
            return total
        if self.simple:
            normal = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        else:
            normal = self.normalizer.normalize(text)[0].decode()
        try:
            return self.total(normal)
        except MemoryError:
            self.transducer = Transducer(self.model)
            return self.total(normal)


def scan(maps: list[ChunkMap], compose: Callable[[ChunkMap, ChunkMap], ChunkMap]) -> list[ChunkMap]:
    """Inclusive prefix scan: neighbours are composed, the scan of the pairs gives every other prefix,
    and one more composition each the rest. The compositions of a level are independent, the levels
    log2(n), and no level reads more than the whole once."""
    if len(maps) < 2:
        return list(maps)
    pairs = scan([compose(a, b) for a, b in zip(maps[::2], maps[1::2])], compose)
    return [maps[0] if not k else pairs[k // 2] if k % 2 else compose(pairs[k // 2 - 1], maps[k]) for k in range(len(maps))]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


@cache
def library(path: str) -> object:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_library(path: str, texts: list[str]) -> list[int]:
    """Counts of a .json tokenizer, by the library that it belongs to."""
    return [len(e.ids) for e in library(path).encode_batch(texts, add_special_tokens=False)]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`df` with the token count of each whole text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if model_path.endswith(".json"):
                found = count_library(model_path, [t or "" for t in texts])
            else:
                c = counter(model_path)
                found = [c.count(t) for t in texts]
            yield pd.Series(found, dtype="int64")

    return df.withColumn(out, F.pandas_udf(run, "bigint")(F.col(text)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, default_model())
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
