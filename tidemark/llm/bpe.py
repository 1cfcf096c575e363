"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

A sentencepiece BPE model merges, among all neighbouring symbols whose concatenation is a piece, the pair with the
highest score, leftmost first. Give every vocabulary entry minus its rank as score, spell its bytes as one character
each, and switch all text normalisation off: the model then merges exactly as the ranks prescribe. Nothing is
trained; the model is the vocabulary in another file format. Pre-tokens are encoded one by one, so no merge crosses
the matches of the split pattern. Decoding looks each id's bytes up and joins them.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, tokens

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Byte b is spelt as the character 256 + b: one character per byte, none of them white space or sentencepiece's own.
_SPELLING = {byte: chr(256 + byte) for byte in range(256)}

#: Fixed values of the sentencepiece model format (protocol buffer field numbers and enumerations).
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 4, 40, 41, 42, 43
BPE = 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. Ranks must be 0, 1, 2 and so on, and hold every single byte."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(text) for text, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))) or not {bytes([b]) for b in range(256)} <= set(ranks.values()):
        raise ValueError(f"{path}: ranks must be dense and cover all bytes")
    return [ranks[rank] for rank in range(len(ranks))]


def spelt(data: bytes) -> str:
    return data.decode("latin-1").translate(_SPELLING)


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """The vocabulary as a sentencepiece model file. Ids are ranks; the unknown piece, never used, comes last."""

    def piece(text: str, score: float, kind: int) -> bytes:
        score_field = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
        return _block(PIECE, _block(PIECE_TEXT, text.encode()) + score_field + _number(PIECE_TYPE, kind))

    unknown = len(vocabulary)
    parts = [piece(spelt(data), -rank, NORMAL) for rank, data in enumerate(vocabulary)]
    parts.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, unknown + 1) + _number(UNK_ID, unknown)
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    switches = b"".join(_number(field, 0) for field in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    normalizer = _block(NAME, b"identity") + switches
    return b"".join(parts) + _block(TRAINER, trainer) + _block(NORMALIZER, normalizer)


class Codec:
    """Encodes texts and decodes ids by one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.vocabulary))
        self.matches = regex.compile(pattern).findall
        self.encode = tokens.Known(self._ids_of, limit=500_000).encode  # encoders and decoders share an executor

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers: all pre-tokens in one call of the model."""
        found = [self.matches(piece) for piece in pieces]
        # 0xFF never occurs in UTF-8, so it can hold the pre-tokens apart while they are respelt
        spelt_all = spelt(b"\xff".join(m.encode() for matches in found for m in matches)).split(_SPELLING[255])
        ids = self.model.encode(spelt_all, num_threads=1) if pieces else []
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = list(accumulate(map(len, ids), initial=0))
        firsts = list(accumulate(map(len, found), initial=0))
        return [flat[4 * ends[a] : 4 * ends[b]] for a, b in pairwise(firsts)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary; rank files come with the installed package on every executor."""
    return Codec(path, pattern)


def encode(text: Column, path: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text column: little-endian unsigned 32-bit integers in a binary. Null counts as empty."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([own.encode(text or "") for text in batch.to_pylist()], pa.binary())

    return ids(text)


def decode(ids: Column, path: str = MULTI, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that a binary of token ids stands for. Null counts as no ids; an id outside the vocabulary fails."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([own.decode(value or b"") for value in batch.to_pylist()], pa.binary())

    return joined(ids)


def round_trip(docs: DataFrame, text: str = "text", path: str = MULTI) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``: every text encoded and decoded again, no shuffle.

    Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded each. Columns of ``docs``
    called ``ids`` or ``decoded`` are replaced. One text is one value, so its length is bounded by a row's size.
    """
    common.bounded_batches(docs.sparkSession)
    return docs.withColumn("ids", encode(F.col(text), path)).withColumn("decoded", decode(F.col("ids"), path))
