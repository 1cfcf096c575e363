"""Exact deduplication by composable polynomial fingerprints.

A text, as bytes b0..bn-1, has the fingerprint sum of b_i * B^(n-1-i) modulo a prime, for two primes. Fingerprints
compose: F(xy) = F(x) * B^|y| + F(y). So a text of any length is hashed in chunks that need nothing of each other,
each yielding its hash and its shift B^length; the chunk hashes are then folded in order. Texts with equal length and
equal fingerprints form a group. Nothing is believed on the word of a hash: each member is compared with the row that
stays, chunk by chunk, as rows of a join. Members that differ from it are grouped anew by a strong digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

#: The two largest primes below 2^31, with a base each; products of residues fit 64 bits.
MODULI, BASES = (2147483647, 2147483629), (911382323, 972663749)
CHUNK = 1 << 16
#: Members of a group per salt: the chunks of the row that stays are sent once per so many members.
PER_SALT = 512

_BLANKS = b" \t\n\r\x0b\x0c"
_CHUNKS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("h1", "h2", "s1", "s2")]))
_MADE = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("chunks", _CHUNKS), T.StructField("text_sha256", T.StringType()),
])


def normalised(data: bytes) -> bytes:
    """Each run of blanks (0x20, 0x09-0x0D) replaced by one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[0] in _BLANKS else b"") + b" ".join(words) + (b" " if data[-1] in _BLANKS else b"")


@lru_cache(maxsize=8)
def _powers(base: int, modulus: int, chunk: int) -> np.ndarray:
    """B^(chunk-1) .. B^0."""
    out, power = np.empty(chunk, np.uint64), 1
    for i in range(chunk - 1, -1, -1):
        out[i] = power
        power = power * base % modulus
    return out


def chunk_hashes(data: bytes, moduli: tuple = MODULI, chunk: int = CHUNK) -> list[tuple[int, ...]]:
    """(hash, hash, shift, shift) of each chunk. The empty text has no chunk."""
    out = []
    for start in range(0, len(data), chunk):
        part = np.frombuffer(data, np.uint8, min(chunk, len(data) - start), start).astype(np.uint64)
        hashes = [int(part @ _powers(b, m, chunk)[chunk - len(part):]) % m for b, m in zip(BASES, moduli)]
        shifts = [pow(b, len(part), m) for b, m in zip(BASES, moduli)]
        out.append((*hashes, *shifts))
    return out


def _combined(which: int, modulus: int):
    """Fold the chunk hashes of a row by length-shifted arithmetic."""
    return F.aggregate(
        "chunks", F.lit(0).cast("long"),
        lambda done, c: (done * c[f"s{which}"] + c[f"h{which}"]) % F.lit(modulus).cast("long"),
    )


def fingerprints(text: Column, moduli: tuple = MODULI, chunk: int = CHUNK) -> Column:
    """n_bytes, chunks (their hashes and shifts) and text_sha256 of a normalised text, as a struct."""

    @F.arrow_udf(_MADE)
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([
            ("n_bytes", pa.int64()), ("chunks", pa.list_(pa.struct([(n, pa.int64()) for n in ("h1", "h2", "s1", "s2")]))),
            ("text_sha256", pa.string()),
        ])
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                data = normalised((value or "").encode())
                chunks = [dict(zip(("h1", "h2", "s1", "s2"), c)) for c in chunk_hashes(data, moduli, chunk)]
                rows.append({"n_bytes": len(data), "chunks": chunks, "text_sha256": hashlib.sha256(data).hexdigest()})
            yield pa.array(rows, kind)

    return hashed(text)


def _chunk_rows(rows: DataFrame, chunk: int, name: str) -> DataFrame:
    """One row per chunk of the normalised text; an empty text has none."""
    plain = rows.withColumn("plain", F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
    last = F.floor((F.char_length("plain") - 1) / chunk).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("plain", i * chunk + 1, F.lit(chunk)))
    cuts = F.when(F.char_length("plain") > 0, cut)
    return plain.select(*[c for c in rows.columns if c != "text"], F.posexplode(cuts).alias("chunk_no", name))


def _grouped(prints: DataFrame, keys: list[str]) -> DataFrame:
    """The row that stays and the size of every group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    found = prints.groupBy(*keys).agg(first, F.count("*").alias("group_size"))
    return found.select(*keys, F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")


def _compared(docs: DataFrame, scratch: common.Scratch, doc_id: str, text: str, moduli: tuple, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(the numbered rows of ``docs`` as a struct, the group of every row number)."""
    body = F.coalesce(F.col(f"doc.{text}"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    rows = rows.select("doc", F.col(f"doc.{doc_id}").alias("doc_id"), fingerprints(body, moduli, chunk).alias("made"))
    rows = rows.select("doc", "doc_id", "made.n_bytes", "made.text_sha256", "made.chunks", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"f1": _combined(1, moduli[0]), "f2": _combined(2, moduli[1])}).drop("chunks")
    numbered = scratch.keep(rows, "numbered")
    prints, keys = numbered.drop("doc"), ["f1", "f2", "n_bytes"]

    groups = scratch.keep(_grouped(prints, keys), "groups")
    members = numbered.select(*keys, "row", body.alias("text")).join(groups.where("group_size > 1"), keys)
    salts = F.ceil(F.col("group_size") / PER_SALT).cast("int")
    salt = F.pmod(F.xxhash64("row"), salts).cast("int").alias("salt")
    members = scratch.keep(members.select("row", "keep_row", "text", salts.alias("salts"), salt), "members")
    copies = members.where("row <> keep_row").drop("salts")
    staying = members.where("row = keep_row").select("keep_row", "text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = _chunk_rows(copies, chunk, "chunk").join(_chunk_rows(staying, chunk, "kept_chunk"), ["keep_row", "salt", "chunk_no"], "left")
    differ = scratch.keep(both.where(~F.col("chunk").eqNullSafe(F.col("kept_chunk"))).select("row").distinct(), "differ")
    scratch.drop("members")
    if not differ.isEmpty():  # texts that differ behind one fingerprint: a digest tells them apart
        prints = prints.join(differ.withColumn("other", F.lit(True)), "row", "left")
        prints = prints.withColumn("apart", F.when(F.col("other"), F.col("text_sha256")).otherwise("")).drop("other")
        keys = [*keys, "apart"]
        groups = scratch.keep(_grouped(prints, keys), "groups-apart")
    return numbered, prints.join(groups, keys).withColumn("kept", F.col("row") == F.col("keep_row"))


def groups_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli: tuple = MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Null texts count as empty. Of equal texts the row with the smallest id stays (nulls last); of rows that repeat
    the id too, exactly one stays. Other columns are left out. Every group, of any size, is handled the same way:
    counts and least ids are combined on the map side, and the comparison salts the row that stays.
    """
    scratch = common.Scratch(docs.sparkSession, "exact-dedup")
    groups = _compared(docs.select(doc_id, text), scratch, doc_id, text, moduli, chunk)[1]
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: common.Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, by the rules of ``groups_of``, with all their columns.

    A caller that passes ``scratch`` can drop it once the result is written.
    """
    scratch = scratch or common.Scratch(docs.sparkSession, "exact-dedup")
    numbered, groups = _compared(docs, scratch, doc_id, text, MODULI, CHUNK)
    return numbered.select("doc", "row").join(groups.where("kept").select("row"), "row", "left_semi").select("doc.*")
