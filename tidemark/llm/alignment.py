"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenisers cut the same bytes. Merging their sorted token ends gives every overlap: each distinct end closes one
stretch of bytes, which belongs to one token of either side. An end that both sides have closes a group.

Merge path: the merge of n ends is cut at every ``PIECE``-th diagonal. A binary search along a diagonal finds how many
ends of either side lie before it, so the pieces between are independent and equal in work, however lengths are
spread over documents. A piece merges its own few ends and emits its overlaps and common ends; what straddles a border is
stitched: a pair of equal ends by a look at the end before the piece, groups by putting the common ends of all pieces
in order.

Texts are cut between a character that is not white space and a blank, where both tokenisers always cut; the words are
encoded once per worker. Documents are merged in chunks and gathered to blocks. A block carries each distinct pair of
ids once, with its count. Counts are added up over the corpus and sent back to the blocks that hold the pair, where they
meet the documents of the block; neither a table of all pairs nor one row per document and pair is needed anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, tokens

#: A: the byte-level 50k vocabulary in its rank form, which gives the ids of its JSON form. B: the 32k piece model.
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
#: Ends in a piece of the merge, and pieces that are merged at once.
PIECE, AT_ONCE = 1024, 1024
#: Tokens of a chunk; a document is never split. Bytes of text and pair entries of a block.
CHUNK, BLOCK_BYTES, BLOCK_ENTRIES = 1 << 20, 16 << 20, 4 << 20
#: Words held by a worker, and their length; longer ones are encoded anew.
HELD, LONGEST = 300_000, 80
#: A task numbers its blocks from partition * 2^BLOCK_BITS.
BLOCK_BITS = 32

_CUT = re.compile(f"(?<=[^{tokens.SPACE}])(?= )")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class Tokenisers:
    """Both encodings of the words of space + text."""

    def __init__(self, ranks_path: str, model_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.bytes_a[rank] = text
        self.bytes_b = []
        for piece in map(self.b.id_to_piece, range(self.b.get_piece_size())):
            byte = _BYTE.fullmatch(piece)
            self.bytes_b.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = self.b.piece_to_id("▁")
        self.names_a, self.names_b = _names(len(self.bytes_a)), _names(len(self.bytes_b))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _encoded(self, words: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """(ids of A, ids of B) of a blank and the word; None if either does not give these bytes back."""
        # the piece model puts the blank in front of a text itself, but gives nothing for an empty one
        for word, ids_b in zip(words, self.b.encode(words, num_threads=1)):
            ids_a, ids_b, data = self.a.encode_ordinary(" " + word), ids_b if word else [self.blank], (" " + word).encode()
            whole = b"".join(map(self.bytes_a.__getitem__, ids_a)) == data == b"".join(map(self.bytes_b.__getitem__, ids_b))
            yield (np.array(ids_a, np.uint32).tobytes(), np.array(ids_b, np.uint32).tobytes()) if whole else None

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides, or None where the text has no tokens."""
        if not text:
            return None
        if text[0] == " " or tokens._blank_after_space(text):
            words = [piece[1:] for piece in _CUT.split(" " + text)]
        else:
            words = text.split(" ")
        try:
            made = list(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > HELD:
                self.known = {}
            new = list({word for word in words if word not in self.known})
            fresh = dict(zip(new, self._encoded(new)))
            made = [fresh[word] if word in fresh else self.known[word] for word in words]
            self.known.update((word, pair) for word, pair in fresh.items() if len(word) <= LONGEST)
        if None in made:
            return None
        return tuple(np.frombuffer(b"".join([pair[side] for pair in made]), np.uint32) for side in (0, 1))


def _names(n: int) -> np.ndarray:
    """Each id's decimal digits and a comma as eight bytes, padded with zero bytes."""
    return np.array([b"%d," % i for i in range(n)], "S8").view(np.uint64)


@lru_cache(maxsize=2)
def tokenisers(ranks_path: str, model_path: str) -> Tokenisers:
    return Tokenisers(ranks_path, model_path)


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of ``a`` and of ``b`` lie before each ``piece``-th element of their merge, by binary search along
    the diagonals; of equal elements that of ``a`` comes first. The first entry is (0, 0), the last both lengths."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (searching := low < high).any():
        mid = (low + high) // 2
        before = searching & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        low, high = np.where(before, mid + 1, low), np.where(searching & ~before, mid, high)
    return low, d - low


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, end_i, end_j) for runs of pieces: overlaps of token i of A and j of B, and after how many tokens of either
    side a common end lies. ``a`` and ``b`` are increasing ends."""
    cut_a, cut_b = diagonals(a, b, piece)
    before = -1  # the key in front of the run
    for s in range(0, len(cut_a) - 1, at_once):
        i, j = cut_a[s : s + at_once + 1], cut_b[s : s + at_once + 1]
        starts = np.arange(len(i) - 1) * piece
        from_a, from_b = np.diff(i), np.diff(j)
        keys = np.full(len(starts) * piece, np.iinfo(np.int64).max)
        keys[np.arange(i[0], i[-1]) + np.repeat(starts - i[:-1], from_a)] = 2 * a[i[0] : i[-1]]
        keys[np.arange(j[0], j[-1]) + np.repeat(starts + from_a - j[:-1], from_b)] = 2 * b[j[0] : j[-1]] + 1
        keys = keys.reshape(-1, piece)
        keys.sort(axis=1)  # each piece merges on its own
        is_b = keys & 1
        seen_b = np.cumsum(is_b, axis=1) - is_b
        of_b = (j[:-1, None] + seen_b).ravel()
        of_a = (i[:-1, None] + np.arange(piece) - seen_b).ravel()
        total = int(i[-1] - i[0] + j[-1] - j[0])
        keys, is_b = keys.ravel()[:total], is_b.ravel()[:total]
        common_end = (is_b == 1) & (keys - 1 == np.append(before, keys[:-1]))
        before = keys[-1]
        of_a, of_b = of_a[:total], of_b[:total]
        yield of_a[~common_end], of_b[~common_end], of_a[common_end], of_b[common_end] + 1


class Chunk:
    """Documents that are merged together. Each ends in a common end, so documents stay apart."""

    def __init__(self, own: Tokenisers, documents: list[tuple[np.ndarray, np.ndarray]]):
        self.own = own
        self.n_a = np.array([len(a) for a, _ in documents], np.int64)
        self.n_b = np.array([len(b) for _, b in documents], np.int64)
        self.a = np.concatenate([a for a, _ in documents])
        self.b = np.concatenate([b for _, b in documents])

    def align(self) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Groups of each document, their digests, and the distinct (document, pair) keys with their counts."""
        ends_a, ends_b = np.cumsum(self.own.lengths_a[self.a]), np.cumsum(self.own.lengths_b[self.b])
        document = np.repeat(np.arange(len(self.n_a)), self.n_a)
        found, times, group_a, group_b = [], [], [], []
        for i, j, end_i, end_j in merged(ends_a, ends_b):
            pairs = (document[i] << 40) + self.a[i].astype(np.int64) * len(self.own.bytes_b) + self.b[j]
            keys, counts = _counted(pairs)
            found.append(keys)
            times.append(counts)
            group_a.append(end_i)
            group_b.append(end_j)
        group_a, group_b = np.concatenate(group_a), np.concatenate(group_b)
        groups = np.diff(np.searchsorted(group_a, np.append(0, np.cumsum(self.n_a)), side="right"))
        return groups, self._digests(group_a, group_b), *_counted(np.concatenate(found), np.concatenate(times))

    def _digests(self, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """SHA-256 of a1,a2|b1;a3|b2,b3 of each document. A token's name takes eight bytes; padding goes at last."""
        names = np.empty(len(self.a) + len(self.b), np.uint64)
        sizes_a, sizes_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        at_a = np.arange(len(self.a)) + np.repeat(group_b - sizes_b, sizes_a)
        at_b = np.arange(len(self.b)) + np.repeat(group_a, sizes_b)
        names[at_a], names[at_b] = self.own.names_a[self.a], self.own.names_b[self.b]
        del at_a, at_b
        text = names.view(np.uint8).reshape(-1, 8)
        length = (text != 0).sum(axis=1)
        for last, mark in ((group_a + group_b - sizes_b - 1, b"|"), (group_a + group_b - 1, b";")):
            text[last, length[last] - 1] = mark[0]
        ends = np.cumsum(length)[np.cumsum(self.n_a + self.n_b) - 1]
        flat = text.ravel()
        flat = flat[flat != 0].tobytes()
        return [hashlib.sha256(memoryview(flat)[start : end - 1]).hexdigest() for start, end in zip(np.append(0, ends[:-1]), ends)]


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what sum of ``times``) they occur."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(keys))) if times is None else np.add.reduceat(times, starts) if len(keys) else times
    return keys[starts], counts


def _small(values: np.ndarray) -> bytes:
    """Values that are not negative, in the fewest bytes that hold the largest; a byte with that width in front."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_FIELDS = [
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("gaps", T.BinaryType()), T.StructField("times", T.BinaryType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


class Block:
    """Documents in a row of one task, with their pairs as places in the block's own list of pairs."""

    def __init__(self):
        self.rows: list[tuple] = []  # id, n_a, n_b, n_groups, digest
        self.owners: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = self.entries = 0

    def add(self, ids: list, documents: list, aligned: tuple) -> None:
        groups, digests, keys, times = aligned
        self.owners.append((keys >> 40) + len(self.rows))
        self.pairs.append(keys & (1 << 40) - 1)
        self.times.append(times)
        self.entries += len(keys)
        self.rows += [(key, len(a), len(b), int(n), text) for key, (a, b), n, text in zip(ids, documents, groups, digests)]

    def add_empty(self, key) -> None:
        self.rows.append((key, 0, 0, 0, ""))

    def emit(self, number: int, key_type: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
        """A row per document, then one row with the block's pairs and their counts."""
        none = np.empty(0, np.int64)
        owners, pairs, times = (np.concatenate(x) if x else none for x in (self.owners, self.pairs, self.times))
        distinct, places = np.unique(pairs, return_inverse=True)
        counts = np.bincount(places, weights=times, minlength=len(distinct)).astype(np.int64)  # below 2^53 in a block
        order = np.argsort(owners, kind="stable")  # chunks and empty documents interleave
        owners, places, times = owners[order], places[order], times[order]
        cuts = np.searchsorted(owners, np.arange(len(self.rows) + 1))
        made = []
        for k, row in enumerate(self.rows):
            own = slice(cuts[k], cuts[k + 1])
            made.append((*row, number, _small(np.diff(places[own], prepend=0)), _small(times[own]), None, None))
        made.append((None, None, None, None, None, number, None, None, distinct, counts))
        for start in range(0, len(made), 2048):
            columns = list(zip(*made[start : start + 2048]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *_ARROW])], names=[name, *[f.name for f in _FIELDS]])


def _blocks(ranks_path: str, model_path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenisers(ranks_path, model_path)
        number = TaskContext.get().partitionId() << BLOCK_BITS
        block, ids, waiting, held = Block(), [], [], 0

        def settle():
            nonlocal ids, waiting, held
            if waiting:
                block.add(ids, waiting, Chunk(own, waiting).align())
            ids, waiting, held = [], [], 0

        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py() or ""
                coded = own.encode(text)
                if coded is None:
                    block.add_empty(key)
                    continue
                ids.append(key)
                waiting.append(coded)
                held += len(coded[0]) + len(coded[1])
                block.size += len(text)
                if held >= CHUNK:
                    settle()
                if block.size >= BLOCK_BYTES or block.entries >= BLOCK_ENTRIES:
                    settle()
                    yield from block.emit(number, key_type, name)
                    block, number = Block(), number + 1
        settle()
        if block.rows:
            yield from block.emit(number, key_type, name)

    return run


def _judged(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a block's pairs brought to its documents."""
    places = pairs["place"].to_numpy()
    counts, best = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    counts[places], best[places] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    n_best, sums = [], []
    for gaps, times in zip(documents["gaps"].to_pylist(), documents["times"].to_pylist()):
        at, times = np.cumsum(_large(gaps)), _large(times)
        n_best.append(int(times[best[at]].sum()))
        sums.append(int(times @ counts[at]))
    n_a, n_b, groups = (documents[c].to_numpy() for c in ("n_a", "n_b", "n_groups"))
    return pa.table({
        "doc_id": documents["doc_id"], "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": n_a + n_b - groups,
        "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": documents["groups_sha256"],
    })


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS, model_path: str = MODEL,
          scratch: common.Scratch | None = None) -> DataFrame:
    """Per row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens do not give back its bytes (it holds U+2581, which the piece model takes
    for a blank), has zeros and an empty digest. Repeated rows count each, null ids stay null. Other columns are left
    out. No rows give no rows. Texts of any length are merged whole; a single word is bounded by memory. A caller that
    passes ``scratch`` can drop it once the result is written.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = scratch or common.Scratch(spark, "alignment")
    own = tokenisers(ranks_path, model_path)
    size_b = len(own.bytes_b)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", kind), *_FIELDS])
    blocks = scratch.keep(rows.mapInArrow(_blocks(ranks_path, model_path, "doc_id"), schema), "blocks", "zstd")

    local = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    local = local.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    total = local.groupBy("pair").agg(F.sum("n").alias("n"))
    most = total.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    judged = scratch.keep(
        total.join(most, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    answers = local.select("block", "place", "pair").join(judged, "pair").select(F.col("block").alias("of_block"), "place", "n", "best")

    documents = blocks.where("pairs is null").drop("pairs", "counts")
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    result = T.StructType([T.StructField("doc_id", kind), *longs, T.StructField("groups_sha256", T.StringType())])
    return documents.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_judged, result)
