"""SentencePiece encoding and decoding that keeps source offsets.

A text is normalised by longest-prefix matches through the model's compiled character map; every
normalised byte remembers the source byte it came from. The normalised text is segmented by the
sentencepiece library with a copy of the model whose own normaliser is switched off, and each piece
is projected back to the span of original bytes it stands for. Decoding is the library's.

Segmentation of a text whose pieces never join a non-space to a following space marker is the
concatenation of the segmentations of its marker-led words; this is read off the vocabulary, and
then words are segmented once a worker and looked up afterwards.

Defined results: a null text counts as empty and has no pieces; U+0000 and unknown characters become
byte pieces if the model has them (the last byte piece of a character holds its span, the earlier
ones an empty span at its start). Whole texts are read, however long; rows that repeat each give their own
row, an empty table none. An output column whose name the input has takes underscores after it, the input's
stays. The model file's path is a parameter; it must be readable on every executor.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO = 200_000
#: Fixed values of the model file's format: field numbers and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6


def default_model() -> str:
    """Path of the public 32k piece model."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out + bytes([value]))


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            size, at = read_varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, kind, value


def message(parts: list[tuple[int, int, int | bytes]]) -> bytes:
    out = bytearray()
    for number, kind, value in parts:
        out += write_varint(number << 3 | kind)
        if kind == 0:
            out += write_varint(value)
        else:
            out += (write_varint(len(value)) if kind == 2 else b"") + value
    return bytes(out)


@dataclass
class Model:
    """What a model file says about pieces and normalisation."""

    pieces: list[tuple[str, float, int]]
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool
    suffix: bool
    byte_fallback: bool
    plain: bytes

    @property
    def words_apart(self) -> bool:
        """No piece joins anything but a space marker to a following space marker."""
        return not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in self.pieces)


def parse_model(data: bytes) -> Model:
    pieces, norm, trainer, parts = [], {}, {}, []
    for number, kind, value in fields(data):
        if number == PIECES:
            own = {n: v for n, _, v in fields(value)}
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
        elif number == NORMALIZER:
            norm = {n: v for n, _, v in fields(value)}
            continue
        elif number == TRAINER:
            trainer = {n: v for n, _, v in fields(value)}
        parts.append((number, kind, value))
    off = message([(1, 2, b"identity"), (3, 0, 0), (4, 0, 0), (5, 0, 0)])
    return Model(
        pieces,
        norm.get(2, b""),
        bool(norm.get(3, 1)),
        bool(norm.get(4, 1)),
        bool(norm.get(5, 1)),
        bool(trainer.get(24, 0)),
        bool(trainer.get(35, 0)),
        message([*parts, (NORMALIZER, 2, off)]),
    )


class Normalizer:
    """Longest-prefix normalisation that records, for each normalised byte, its source byte."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.marker = SPACE.encode() if model.escape else b" "
        self.own = sorted((p.encode() for p, _, kind in model.pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.trie: list[int] = []
        self.texts = b""
        if model.charsmap:
            size = struct.unpack_from("<I", model.charsmap)[0]
            self.trie = list(struct.unpack_from(f"<{size // 4}I", model.charsmap, 4))
            self.texts = model.charsmap[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) of the longest key of the compiled map at `at`.
        The map is a double array: a node's children stand at its offset XOR their byte."""
        trie, found = self.trie, None
        unit = trie[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(trie):
                break
            unit = trie[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, trie[node] & 0x7FFFFFFF)
        return found

    def step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes consumed at `at`, and what they become."""
        for piece in self.own:
            if data.startswith(piece, at):
                return len(piece), piece
        if self.trie and (hit := self.longest(data, at)):
            size, place = hit
            return size, self.texts[place : self.texts.index(b"\0", place)]
        lead = data[at]
        size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]

    def normalize(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and the source offset of each of them and of their end."""
        data, mark, tight = text.encode(), self.marker, self.model.remove_extra
        out, places, at = bytearray(), [], 0
        while tight and at < len(data):
            size, became = self.step(data, at)
            if became != b" ":
                break
            at += size
        if at == len(data):
            return b"", [0]

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            places.extend([source] * len(piece))

        if self.model.dummy_prefix and not self.model.suffix:
            put(mark, at)
        after_space = tight
        while at < len(data):
            size, became = self.step(data, at)
            while after_space and became.startswith(b" "):
                became = became[1:]
            if became:
                for k, part in enumerate(became.split(b" ")):
                    if k:
                        put(mark, at)
                    put(part, at)
                after_space = tight and became.endswith(b" ")
            at += size
        while tight and out.endswith(mark):
            del out[-len(mark) :]
            at = places[len(out)]
            del places[len(out) :]
        if self.model.dummy_prefix and self.model.suffix:
            put(mark, at)
        return bytes(out), [*places, at]


def unpack(parts: Iterable[bytes]) -> np.ndarray:
    """One array of the int32 values that the parts hold."""
    return np.frombuffer(bytearray(b"".join(parts)), dtype=np.int32)


@dataclass
class Encoding:
    """Pieces of one text and the spans of original UTF-8 bytes they stand for."""

    ids: list[int]
    begins: np.ndarray
    ends: np.ndarray


class Codec:
    """Encoder and decoder of one model; `of` keeps one a worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = parse_model(data)
        self.normalizer = Normalizer(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=self.model.plain)
        self.sizes = [1 if kind == BYTE else len(p.encode()) for p, _, kind in self.model.pieces]
        self.first_byte = next((i for i, x in enumerate(self.model.pieces) if x[2] == BYTE), None)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.by_word = self.model.words_apart and self.model.byte_fallback
        self.simple = self.by_word and self.model.escape and self.model.dummy_prefix and not (self.model.charsmap or self.model.remove_extra or self.model.suffix or self.normalizer.own)
        self.memo: dict[str, tuple[bytes, str, bytes]] = {}
        self.marked = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def words(self, chunks: list[str]) -> list[tuple[bytes, str, bytes]]:
        """For each marker-led word: ids packed as int32, the ids as text, and the normalised byte
        counts of its pieces packed as int32. Words not seen yet are segmented in one call."""
        memo = self.memo
        if new := set(chunks).difference(memo):
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set(chunks)
            fresh = list(new)
            for chunk, ids in zip(fresh, self.plain.encode(fresh, num_threads=1)):
                memo[chunk] = (struct.pack(f"={len(ids)}i", *ids), ",".join(map(str, ids)), struct.pack(f"={len(ids)}i", *map(self.sizes.__getitem__, ids)))
        return [memo[c] for c in chunks]

    def segment(self, normal: str) -> tuple[list[int], np.ndarray]:
        """Ids of a normalised text, and the normalised bytes each covers."""
        if self.by_word:
            parts = self.words(self.marked.findall(normal))
            return unpack(p[0] for p in parts).tolist(), unpack(p[2] for p in parts).astype(np.int64)
        pieces = self.plain.encode(normal, return_type="proto").pieces
        return [p.id for p in pieces], np.array([len(p.surface.encode()) for p in pieces], dtype=np.int64)

    def encode(self, text: str | None) -> Encoding:
        """Ids and spans by the general path."""
        normal, places = self.normalizer.normalize(text or "")
        ids, sizes = self.segment(normal.decode())
        stops = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        source = np.asarray(places, dtype=np.int64)
        return self.spans(ids, source[stops])

    def spans(self, ids: list[int], edges: np.ndarray) -> Encoding:
        """Spans from the edges between pieces; the byte pieces of one character get its span on the last."""
        begins, ends = edges[:-1].copy(), edges[1:].copy()
        if self.first_byte is not None and len(ids):
            a = np.asarray(ids)
            own = self.is_byte[a]
            if own.any():
                value = a - self.first_byte
                goes_on = own & (value >= 0x80) & (value < 0xC0)
                start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(a))))
                begins = np.where(own, begins[start], begins)
                last = own & ~np.append(goes_on[1:], False)
                ends = np.where(own & ~last, begins, ends)
        return Encoding(ids, begins, ends)

    def quick(self, text: str) -> tuple[list[int], str, np.ndarray]:
        """Ids, ids as text and original bytes of each piece, where the map is empty and a space
        simply becomes a marker: alignment is then arithmetic."""
        ids, said, sizes = zip(*self.words((SPACE + text.replace(" ", f" {SPACE}")).split(" ")))
        covered = unpack(sizes)
        covered[np.cumsum([0, *map(len, ids[:-1])]) // 4] -= 2  # the marker's three bytes stand for one space,
        covered[0] -= 1  # or for none before the text
        return unpack(ids).tolist(), ",".join(said), covered

    def digest(self, text: str | None) -> tuple[int, str, str, int, bool]:
        """Tokens, digest of the ids, digest of the decoded text, bytes that spans cover, and
        whether the spans tile the text."""
        text = text or ""
        size = len(text.encode())
        if self.simple and text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            ids, said, sizes = self.quick(text)
            tiled = bool(sizes.sum() == size)
            covered = int(sizes.sum())
        else:
            got = self.encode(text)
            ids, said = got.ids, ",".join(map(str, got.ids))
            spans = got.ends - got.begins
            covered, tiled = int(spans.sum()), bool((got.begins[1:] == got.ends[:-1]).all()) and int(spans.sum()) == size
        back = self.library.decode(ids) if ids else ""
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), covered, tiled


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`df` with ids, begins and ends (byte offsets) of each whole text."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for texts in batches:
            got = [c.encode(t) for t in texts]
            yield pd.DataFrame({"ids": [g.ids for g in got], "begins": [g.begins for g in got], "ends": [g.ends for g in got]})

    made = F.pandas_udf(run, "struct<ids:array<int>,begins:array<bigint>,ends:array<bigint>>")
    name = fresh(df, "_p")
    return df.withColumn(name, made(F.col(text))).select(*df.columns, *(F.col(f"{name}.{c}").alias(fresh(df, c)) for c in ("ids", "begins", "ends")))


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text that the library makes of each row's ids; null ids give an empty text."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_path)
        for rows in batches:
            yield pd.Series([c.library.decode([int(i) for i in r]) if r is not None and len(r) else "" for r in rows], dtype="object")

    return df.withColumn(fresh(df, out), F.pandas_udf(run, "string")(F.col(ids)))


def digests(df: DataFrame, model_path: str, text: str = "text", name: str = "_p") -> DataFrame:
    """`df` with the struct `name`: what encoding and decoding each whole text gives, in short."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for texts in batches:
            yield pd.DataFrame([c.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", "spans_tile"])

    made = F.pandas_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,span_bytes:bigint,spans_tile:boolean>")
    return df.withColumn(name, made(F.col(text)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, default_model()).select("doc_id", "_p.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: each document that is left, with its pieces' digest."""
    name = fresh(docs, "found")
    return digests(docs, default_model(), name=name).select(*docs.columns, *(F.col(f"{name}.{c}").alias(fresh(docs, c)) for c in ("n_tokens", "ids_sha256", "decoded_sha256")))
