"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: each token's bytes are
mapped to 256 printable characters, its score is the negative rank, the
normaliser is the identity. A text is split by the pre-token pattern; each
distinct pre-token of a batch is encoded once; decoding maps ids back to pieces
and pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, text_or_empty

#: Pre-tokens that a worker learns before it forgets those that it has not met since the last so many.
MEMORY = 200_000


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece ``rank + 1`` is the token of that rank."""
    letters = byte_letters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))

    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [piece("<unk>", 0.0, 2), *(piece("".join(letters[b] for b in t), -float(r), 1) for r, t in enumerate(by_rank))]
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + b"".join(_varint(k << 3) + _varint((1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in a worker; remembers the pre-tokens it has met."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.table = dict(enumerate(self.letters))
        self.tokens: dict[int, bytes] = {}
        self.pieces: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def token(self, i: int) -> bytes:
        """Bytes of one id, read from its piece once."""
        found = self.tokens.get(i)
        if found is None:
            found = self.tokens[i] = bytes([self.back[c] for c in self.model.id_to_piece(int(i) + 1)])
        return found

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.token(i) for i in ids])

    def learn(self, words: set[str]) -> None:
        if len(self.pieces) + len(words) > MEMORY:
            self.pieces, self.older = {}, self.pieces
        todo = []
        for w in words:
            if w not in self.pieces:
                if w in self.older:
                    self.pieces[w] = self.older[w]
                else:
                    todo.append(w)
        mapped = [w.encode("utf-8").decode("latin-1").translate(self.table) for w in todo]
        for w, ids in zip(todo, self.model.encode(mapped, num_threads=1), strict=True):
            own = tuple(i - 1 for i in ids)
            self.pieces[w] = own, ",".join(map(str, own)), self.bytes_of(own)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [i for w in words for i in self.pieces[w][0]]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count of ids, hash of the ids as decimal text, hash of the decoded bytes."""
        words = self.split(text)
        self.learn(set(words))
        found = [self.pieces[w] for w in words]
        ids = hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest()
        return sum(len(f[0]) for f in found), ids, hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()


def _codec_task(model: bytes, pattern: str, make):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, pattern)
        for batch in batches:
            yield make(codec, batch)

    return task


def encode(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of each whole text; null text is empty and has no ids."""
    bounded_batches(docs.sparkSession)

    def make(codec, batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_codec_task(model_bytes(read_ranks(vocabulary)), pattern, make), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, bytes binary`` from ``doc_id, ids``; null ids give empty bytes."""
    bounded_batches(encoded.sparkSession)

    def make(codec, batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.bytes_of(ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(_codec_task(model_bytes(read_ranks(vocabulary)), pattern, make), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each whole text in one pass over the rows.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row; null
    text counts as empty (no tokens, hashes of nothing). Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)

    def make(codec, batch):
        found = [codec.digest(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_codec_task(model_bytes(read_ranks(vocabulary)), pattern, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
