"""Document fingerprints: quartile bucket digests that can be compared.

Byte triplets (of each window of four bytes, the three that hold its first byte) are hashed into buckets and counted.
A bucket's code says in which quarter of all bucket counts it lies, in two bits; so the digest forgets length, but
keeps which triplets are frequent. A logarithmic code of the length in bytes stands in front. Two digests differ by the sum
of the distances of their bucket codes and by their lengths, up to a limit: 0 for equal texts, about the whole range for
unrelated ones. ``likeness`` turns that into 1 to 0.

``with_next`` puts rows in descending id order by one range shuffle and goes through each sorted part once. What meets
at the border of two parts, the last row of one and the first of the next, is stitched by a join of two rows per part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: Buckets are 2^BUCKET_BITS; steps of the length code to a doubling; the byte places of the counted triplets.
BUCKET_BITS, LENGTH_STEPS, PLACES = 9, 64, ((0, 1, 2), (0, 1, 3), (0, 2, 3))
MULTIPLIER = 2654435761
#: likeness = 1 - (CODE_WEIGHT * code distance + LENGTH_WEIGHT * length distance) / RANGE, 0 at least. Three quarters of the
#: range are what codes of unrelated texts are expected to differ by (1.25 a bucket), one quarter is the length's.
CODE_WEIGHT, LENGTH_WEIGHT, LENGTH_MOST, RANGE = 3, 10, 64, 2560
SLICE = 1 << 20

_KIND = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()), T.StructField("text", T.StringType()),
])
RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall on each bucket; long texts are counted in slices."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for start in range(0, len(data), SLICE):
        codes = np.frombuffer(data, np.uint8, min(SLICE + 3, len(data) - start), start).astype(np.uint32)
        for kind, (p, q, r) in enumerate(PLACES):
            n = min(len(codes) - r, SLICE)  # windows that begin in this slice
            if n > 0:
                triplets = (codes[p : p + n] << 16) + (codes[q : q + n] << 8) + codes[r : r + n] + np.uint32(kind << 24)
                hashed = (triplets * np.uint32(MULTIPLIER)) >> np.uint32(32 - BUCKET_BITS)
                counts += np.bincount(hashed, minlength=len(counts))
    return counts


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 for each bucket: how many of the three quartiles of all counts it exceeds."""
    quarter = len(counts) // 4
    ordered = np.sort(counts)
    return np.sum([counts > ordered[k * quarter - 1] for k in (1, 2, 3)], axis=0, dtype=np.uint8)


def length_code(n_bytes: int) -> int:
    """0 for nothing, then LENGTH_STEPS to each doubling."""
    if not n_bytes:
        return 0
    octave = n_bytes.bit_length() - 1
    return LENGTH_STEPS * (octave + 1) + ((n_bytes * LENGTH_STEPS) >> octave) - LENGTH_STEPS


def digest(data: bytes) -> str:
    """Four hexadecimal digits of the length code, then two bits a bucket."""
    codes = quartile_codes(bucket_counts(data)).reshape(-1, 4)
    packed = (codes[:, 0] << 6) | (codes[:, 1] << 4) | (codes[:, 2] << 2) | codes[:, 3]
    return f"{length_code(len(data)):04x}" + packed.tobytes().hex()


def _unpacked(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
    return int(fingerprint[:4], 16), np.stack([(packed >> s) & 3 for s in (6, 4, 2, 0)], axis=1).astype(np.int16)


def likeness(one: str, other: str) -> float:
    """1 for equal digests, down to 0: a bounded difference score, the same both ways."""
    (length, codes), (length_2, codes_2) = _unpacked(one), _unpacked(other)
    apart = CODE_WEIGHT * int(np.abs(codes - codes_2).sum()) + LENGTH_WEIGHT * min(abs(length - length_2), LENGTH_MOST)
    return (RANGE - min(apart, RANGE)) / RANGE


def edited(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many (or all) of the next text's first ones."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(text: str, own: str, following: str, next_print: str) -> tuple:
    """The columns of RESULT."""
    data = edited(text, following).encode()
    changed = digest(data)
    return len(text), hashlib.sha256(data).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)


def _table(keys: list, key_type: pa.DataType, rows: list[tuple], name: str) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string()]
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *arrays], names=[name, *_KIND.names])


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: common.Scratch | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the one with the next smaller id; after the last comes the first, so a table of one row is its own
    successor. Null ids come last; rows that repeat an id are ordered by a hash of their text, and rows equal in both
    count each. A null text is empty; texts under three bytes count no triplet and differ by length only. Other columns
    are left out. No rows give no rows. A caller that passes ``scratch`` can drop it once the result is written.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = scratch or common.Scratch(spark, "fingerprints")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the last key only spreads rows that are equal in both others
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("row")]
    ranged = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            keys, made = [], []
            key_type = batch.column(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = digest(value.encode())
                if before is None:
                    keys.append(key)
                    made.append(("first", part, None, None, own, None, None, None, value))
                else:
                    keys.append(before[0])
                    made.append(("done", part, *_compared(before[1], before[2], value, own), None))
                before = key, value, own
            if keys:
                yield _table(keys, key_type, made, "doc_id")
        if before is not None:
            yield _table([before[0]], key_type, [("last", part, None, None, before[2], None, None, None, before[1])], "doc_id")

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *_KIND.fields])
    walked = scratch.keep(ranged.mapInArrow(walk, schema), "walked")
    return walked.where("kind = 'done'").select("doc_id", *RESULT).unionByName(_stitched(walked, schema))


def _stitched(walked: DataFrame, schema: T.StructType) -> DataFrame:
    """The last row of each part with the first row of the next part that has rows. Two rows a part."""
    first = walked.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = walked.where("kind = 'last'").select("doc_id", "part", "text", "fingerprint")
    parts = walked.where("kind = 'first'").select("part")  # a number for each part, nothing of the documents
    order = W.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())).alias("next_part"))
    both = last.join(after, "part").join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    fields = [schema["doc_id"], *[_KIND[name] for name in RESULT]]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_compared(*values) for values in zip(*[c.to_pylist() for c in batch.columns[1:]])]
            kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            columns = list(zip(*made)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *RESULT])

    return both.mapInArrow(compare, T.StructType(fields))
