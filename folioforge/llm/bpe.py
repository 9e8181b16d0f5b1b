"""Byte-level BPE with a sentencepiece model that is written directly from a rank file.

Each byte b of the vocabulary becomes the character U+0100+b, each entry a piece whose score is its negative rank, so
that sentencepiece merges in rank order. Normalisation is the identity. Pre-tokens are encoded one by one; an entry
that equals a whole pre-token stands for it at once, as in the rank file's own library. Decoding maps ids to bytes.

Defined results: a null text is the empty text (no ids, no bytes); null ids decode to no bytes. Rows are never merged,
so repeated rows stay repeated, and other columns pass through untouched. Work and memory are per document; the word
cache is bounded.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens of at most this many characters are remembered, at most this many of them.
CACHED_LENGTH, CACHED_WORDS = 32, 120_000
_TO_PIECE = {b: chr(0x100 + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, file)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[rank] for rank in range(len(ranks))]


def as_piece(entry: bytes) -> str:
    return entry.decode("latin-1").translate(_TO_PIECE)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the id after the last is the unused unknown piece."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, as_piece(entry).encode()) + _field(2, -float(rank)) + _field(3, normal)) for rank, entry in enumerate(entries)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(entries)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts; lives in one Python worker."""

    def __init__(self, model: bytes, entries: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the rank file's own library takes \s as Unicode's White_Space
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.whole = {entry: [rank] for rank, entry in enumerate(entries)}
        self.cache: dict[str, list[int]] = {}

    def add(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of words that are not in the cache yet; short ones are kept there."""
        found, rest = {}, []
        for word in words:
            if (ids := self.whole.get(word.encode())) is not None:
                found[word] = ids
            else:
                rest.append(word)
        found.update(zip(rest, self.processor.encode([as_piece(word.encode()) for word in rest], num_threads=1), strict=True))
        if len(self.cache) + len(found) > CACHED_WORDS:
            self.cache.clear()
        self.cache.update((word, ids) for word, ids in found.items() if len(word) <= CACHED_LENGTH)
        return found

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        get = self.cache.get
        parts = [get(word) for word in words]
        if None in parts:
            new = self.add(list({word for word, ids in zip(words, parts, strict=True) if ids is None}))
            parts = [new[word] if ids is None else ids for word, ids in zip(words, parts, strict=True)]
        return np.fromiter((i for ids in parts for i in ids), "<u4", sum(map(len, parts)))


def encoded_batches(encoder: Encoder, batches: Iterator[pa.RecordBatch], text: str, into: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 64):
            part = batch.slice(start, 64)
            ids = [encoder.encode(value or "").tobytes() for value in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, into])


def decoded_batches(entries: list[bytes], batches: Iterator[pa.RecordBatch], ids: str, into: str) -> Iterator[pa.RecordBatch]:
    entry = entries.__getitem__
    for batch in batches:
        for start in range(0, len(batch), 64):
            part = batch.slice(start, 64)
            out = [b"".join(map(entry, np.frombuffer(value or b"", "<u4").tolist())) for value in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, into])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with the column ``into``: the ids of each whole text as little-endian unsigned 32-bit integers."""
    entries = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((sentencepiece_model(entries), entries))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(Encoder(*shared.value, pattern), batches, text, into)

    docs = docs.drop(into)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())]))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """encoded with the column ``into``: the bytes that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded_batches(shared.value, batches, ids, into)

    encoded = encoded.drop(into)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """docs without its text, with the columns of ``encode`` and of ``decode`` on its ids.

    Both run in one Python worker a task. Two calls in a row take two workers a task, and executors keep these, with all
    their memory, for whatever runs next.
    """
    entries = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((sentencepiece_model(entries), entries))
    docs = docs.drop(ids, into)
    rest = [x for x in docs.schema.fields if x.name != text]
    names = [*(x.name for x in rest), ids, into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, entries = shared.value
        coded = encoded_batches(Encoder(model, entries, pattern), batches, text, ids)
        return (batch.select(names) for batch in decoded_batches(entries, coded, ids, into))

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(ids, T.BinaryType()), T.StructField(into, T.BinaryType())]))


def told() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with token_ids and decoded."""
    return [
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Counts and digests of the round trip: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs.select("doc_id", "text"), vocabulary, pattern).drop("text"), vocabulary)
    return both.select("doc_id", *told())
