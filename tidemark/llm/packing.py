"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Online, per task: an array counts the partially filled windows at each fill level. A document goes to the level, or
to a new window, after which the sum of the squared counts is smallest; this keeps levels varied, so that later
documents find a gap that they fill exactly. Documents longer than a window give whole windows first. A full window
is complete and leaves memory. What is open at the end of a task (or when ``max_open`` windows are open) is settled
by cutting: the emptiest windows fill the gaps of the fullest ones. Of the one window then left, pieces as long as
powers of two become sequences of their own, which need no padding. So only settled windows cut a document.

There is no shuffle: every task packs the documents of its own partition, tokenising as it goes.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import common, tokens

#: The 50k byte-level vocabulary, as ranks. The library that reads the JSON form gives the same ids, more slowly.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The JSON form, which alone lists the added tokens.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW, END = 2048, 1
#: A task numbers its sequences from partition * 2^SEQUENCE_BITS.
SEQUENCE_BITS = 36


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The added tokens of a vocabulary's JSON form, which the library matches inside texts, special or not."""
    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or any(map(str.isspace, token["content"])):
            raise ValueError(f"the rank form cannot match the added token {token['content']!r} as the library does")
    return {token["content"]: token["id"] for token in added}


class Tokens:
    """Text -> ids as little-endian unsigned 32-bit bytes, with a cache of pieces per worker.

    An added token's text is that token wherever it stands. It holds no white space, so no cut goes through it.
    """

    def __init__(self, ranks_path: str, vocabulary: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, filter(bytes.strip, lines))}
        added = added_tokens(vocabulary)
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def ids_of(piece: str) -> list[int]:
            return own.encode(piece, allowed_special="all") if any(text in piece for text in added) else own.encode_ordinary(piece)

        def encode(pieces: list[str]) -> list[bytes]:
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(ids_of, pieces)]

        self.encode = tokens.Known(encode).encode


@lru_cache(maxsize=2)
def tokens_of(ranks_path: str, vocabulary: str) -> Tokens:
    return Tokens(ranks_path, vocabulary)


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: 4 * n], self.total), Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # entry 0 and the full level stay 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.open = 0

    def choose(self, size: int) -> int:
        """The level to put ``size`` ids on; 0 is a new window. Ties: the fullest level, a new window last."""
        n, room = self.counts, self.window - size
        best, least = 0, 2 * n[size] + 1
        if room > 0:
            at = n[1 : room + 1]
            change = 2 * (n[1 + size : room + size + 1] - at) + 2
            change[-1] -= 1  # a window that becomes full adds no count
            change[at == 0] = np.iinfo(np.int64).max
            level = room - int(np.argmin(change[::-1]))
            if change[level - 1] <= least:
                best = level
        return best

    def put(self, piece: Piece) -> list[Piece] | None:
        """Place a piece shorter than a window; the window's pieces if that filled it."""
        level = self.choose(len(piece))
        if level:
            content = self.windows[level].pop()
            self.counts[level] -= 1
        else:
            content = []
            self.open += 1
        content.append(piece)
        level += len(piece)
        if level == self.window:
            self.open -= 1
            return content
        self.windows[level].append(content)
        self.counts[level] += 1
        return None

    def settle(self) -> Iterator[list[Piece]]:
        """Close everything: cut pieces of the emptiest windows into the gaps of the fullest; powers of two at last."""
        left = [content for level in self.windows for content in level]  # emptiest first
        spare: list[Piece] = []
        first, last = 0, len(left) - 1
        while first <= last:
            content, gap = left[last], self.window - sum(map(len, left[last]))
            last -= 1
            while gap and (spare or first <= last):
                if not spare:
                    spare = left[first]
                    first += 1
                head = spare.pop()
                if len(head) > gap:
                    head, tail = head.cut(gap)
                    spare.append(tail)
                content.append(head)
                gap -= len(head)
            if gap:
                spare = content
            else:
                yield content
        size = 1 << (self.window.bit_length() - 1)
        while spare:
            while size > sum(map(len, spare)):
                size >>= 1
            content, gap = [], size
            while gap:
                head = spare.pop(0)
                if len(head) > gap:
                    head, tail = head.cut(gap)
                    spare.insert(0, tail)
                content.append(head)
                gap -= len(head)
            yield content
        self.__init__(self.window)


def sequences(documents: Iterator[tuple[object, bytes]], window: int, max_open: int) -> Iterator[list[Piece]]:
    """Complete sequences of (id, ids) documents, in the order in which they become complete."""
    levels = LevelArray(window)
    for doc, ids in documents:
        whole = Piece(doc, 0, ids, len(ids) // 4)
        while len(whole) >= window:
            head, whole = whole.cut(window)
            yield [head]
        if len(whole):
            full = levels.put(whole)
            if full:
                yield full
            elif levels.open > max_open:
                yield from levels.settle()
    yield from levels.settle()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END,
         ranks_path: str = RANKS, max_open: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents: id, start, length, ids, doc_tokens, sequence_id, offset.

    A null or empty text is the one id ``end``. Repeated rows are packed each; a null id stays null. Other columns
    are left out. No rows give no rows. The text of an added token of ``vocabulary`` is that token. ``ids`` are little-endian unsigned 32-bit integers. ``max_open`` bounds the
    memory of a task (at most that many windows of ids); it drops nothing.
    """
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField(doc_id, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, closing = tokens_of(ranks_path, vocabulary), struct.pack("<I", end)
        number = TaskContext.get().partitionId() << SEQUENCE_BITS
        key_type = None

        def documents():
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield key, own.encode(value or "") + closing

        def made(rows):
            names, columns = schema.names, list(zip(*rows))
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        rows, held = [], 0
        for content in sequences(documents(), window, max_open):
            offset = 0
            for piece in content:
                rows.append((piece.doc, piece.start, len(piece), piece.ids, piece.total, number, offset))
                offset += len(piece)
            number, held = number + 1, held + offset
            if held > 1 << 20:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.select(doc_id, text).mapInArrow(run, schema)
