"""Character n-gram counts of whole texts, and their document frequencies over a table.

A gram is hashed into a fixed number of buckets, so a vector's size does not depend on the corpus. Texts are counted
in slices of bounded length that overlap by the gram's length less one: any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself in lower case if it is a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        character = chr(code)
        if character.isalpha():
            lowered = character.lower()
            out[code] = ord(lowered) if len(lowered) == 1 else code
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> one of eight classes: lower case and caseless letters, capitals, digits, blanks, line ends,
    sentence marks, exclamation marks, everything else."""
    out = np.full(0x110000, 7, np.uint8)
    for code in range(0x110000):
        character = chr(code)
        if character.isalpha():
            out[code] = 1 if character.isupper() else 0
        elif character.isdigit():
            out[code] = 2
        elif character in "\n\r":
            out[code] = 4
        elif character.isspace():
            out[code] = 3
        elif character in ".,;:'\"-?()":
            out[code] = 5
        elif character == "!":
            out[code] = 6
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _trigrams(codes: np.ndarray, bits: int) -> np.ndarray:
    mixed = codes[:-2] * _MIX[0] + codes[1:-1] * _MIX[1] + codes[2:] * _MIX[2]
    return mixed >> np.uint32(32 - bits)


def letter_counts(text: str, bits: int) -> np.ndarray | None:
    """Counts of the letter trigrams of ``text`` (case folded, all else as blanks); None without any letter."""
    counts, any_letter = np.zeros(1 << bits, np.float32), False
    for start in range(0, len(text), SLICE):
        codes = _letters()[_codes(text[start : start + SLICE + 2])]
        any_letter = any_letter or bool((codes != 32).any())
        edge = np.array([32], np.uint32)
        codes = np.concatenate([edge if start == 0 else edge[:0], codes, edge if start + SLICE >= len(text) else edge[:0]])
        if len(codes) > 2:
            inner = codes[1:-1] != 32  # a blank in the middle holds two unrelated words together
            counts += np.bincount(_trigrams(codes, bits)[inner], minlength=1 << bits)
    return counts if any_letter else None


def surface_counts(text: str, bits: int) -> np.ndarray:
    """Counts of character trigrams as written, then of 4-grams of character classes (4,096 more buckets)."""
    counts = np.zeros((1 << bits) + 4096, np.float32)
    for start in range(0, len(text), SLICE):
        part = text[start : start + SLICE + 3]
        codes = _codes(part)
        if len(codes) > 2:
            tail = codes if start + SLICE + 3 > len(text) else codes[:-1]
            counts[: 1 << bits] += np.bincount(_trigrams(tail, bits), minlength=1 << bits)
        if len(codes) > 3:
            k = _classes()[codes].astype(np.uint16)
            counts[1 << bits :] += np.bincount(k[:-3] << 9 | k[1:-2] << 6 | k[2:-1] << 3 | k[3:], minlength=4096)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors of (1 + ln tf) * idf; a zero row stays zero."""
    out = np.log1p(np.maximum(counts, 1) - 1, dtype=np.float32) + 1
    out *= (counts > 0) * idf
    length = np.linalg.norm(out, axis=-1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def inverse_frequencies(docs: DataFrame, text: str, size: int, counts_of: Callable[[str], np.ndarray | None]) -> np.ndarray:
    """Smoothed idf of every bucket over all rows of ``docs``.

    Each task sums over its rows and hands on one row per bucket in use; ``size`` rows come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts = counts_of(value or "")
                rows += 1
                if counts is not None:
                    seen += counts > 0
        used = np.flatnonzero(seen)
        names = ["bucket", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], names=names)

    sums = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {row["bucket"]: row["n"] for row in sums}
    n, seen = found.pop(-1, 0), np.zeros(size)
    for bucket, count in found.items():
        seen[bucket] = count
    return (np.log((n + 1) / (seen + 1)) + 1).astype(np.float32)
