"""Byte-level BPE encoding and decoding through a sentencepiece model built from the vocabulary.

A ranks file (base64 token, rank) is serialised straight into a sentencepiece BPE model: each byte
becomes one character, each token one piece scored by its negative rank, with identity
normalisation.  sentencepiece then merges the adjacent pair with the best score, leftmost first,
which is the order in which byte-level BPE merges by rank.  Texts are cut into pre-tokens by the
tokenizer's pattern; distinct pre-tokens are encoded once and kept in a bounded worker cache.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Byte b is written as the character U+0100 + b: no white space and no control characters.
TO_CHAR = {b: 0x100 + b for b in range(256)}
#: Pre-tokens that a worker remembers before it starts over.
CACHE = 300_000
#: Texts of these characters only are cut by the standard library, where its classes agree with Unicode's.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1\xa7\xa9\xab\xae\xb0\xb7\xbb\xbf-įĲ-ňŊ-ž]*")
#: The byte-level pattern in the standard library's terms, for such texts.
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The pattern that PLAIN_PATTERN restates; any other pattern goes to the regex module.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids follow the order of the ranks, with <unk> last."""
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = token.decode("latin-1").translate(TO_CHAR).encode()
        pieces.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBpe:
    """Encodes and decodes texts; ``encode`` returns little-endian unsigned 32-bit ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_PATTERN, cache: int = CACHE):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.ids = np.array([r for _, r in tokens], "<u4")
        self.tokens = {r: t for t, r in tokens}
        self.find = regex.compile(pattern).findall
        self.plain = pattern == BYTE_PATTERN
        self.known: dict[str, bytes] = {}
        self.limit = cache

    def pre_tokens(self, text: str) -> list[str]:
        if self.plain and PLAIN.fullmatch(text):
            return PLAIN_PATTERN.findall(text)
        return self.find(text)

    def encode(self, text: str) -> bytes:
        cut, known = self.pre_tokens(text), self.known
        new = list(set(cut).difference(known))
        if new:
            if len(known) > self.limit:
                known.clear()
                new = list(set(cut))
            for t, ids in zip(new, self.sp.encode([t.encode().decode("latin-1").translate(TO_CHAR) for t in new], num_threads=1)):
                known[t] = self.ids[ids].tobytes()
        return b"".join(map(known.__getitem__, cut))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for a worker's life, so that its cache serves every task."""
    return ByteBpe(read_ranks(path), pattern)


def encode_texts(df: DataFrame, path: str, pattern: str = BYTE_PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of long) of every row.  A null text encodes as the empty text; empty
    tables give no rows; repeated rows are each encoded; other columns are left out."""

    def make():
        c = codec(path, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            return {"key": batch.column("key"), "ids": [np.frombuffer(c.encode(t or ""), "<u4").astype("i8") for t in texts]}

        return work

    return by_batch(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key long, ids array<long>", make).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, path: str, pattern: str = BYTE_PATTERN, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``text`` (binary) by inverse mapping of every row's ids.  Null ids give empty bytes."""

    def make():
        c = codec(path, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            rows = batch.column("ids").to_pylist()
            return {"key": batch.column("key"), "text": [c.decode(np.array(r or [], "<u4").tobytes()) for r in rows]}

        return work

    return by_batch(df.select(F.col(key).alias("key"), F.col(ids).alias("ids")), "key long, text binary", make).withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str = BYTE_PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``df`` (doc_id, text).

    Null and empty texts have 0 tokens and the digests of empty bytes; a null doc_id stays null;
    repeated rows give repeated results; other columns are ignored.
    """

    def make():
        c = codec(path, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            n, first, second = [], [], []
            for text in batch.column("text"):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": first, "decoded_sha256": second}

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return by_batch(df.select(F.col("doc_id").cast("long"), "text"), schema, make)
