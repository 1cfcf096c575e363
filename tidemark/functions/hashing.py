"""Digests of files, rows and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def content_digest(content: Column | str) -> Column:
    """SHA-256 in hex of text or bytes."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def _token(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        text = F.col(name).cast("decimal(38,4)").cast("string")
    else:
        text = F.trim(F.col(name).cast("string"))
    return F.coalesce(text, F.lit("NULL"))


def row_digest(df: DataFrame, fields: Sequence[str]) -> Column:
    """Canonical digest of the named fields: four decimals for numbers, trimmed text, NULL spelled out.

    It looks at typed values, so ``1500.0`` and ``1500.00`` are the same money and the same row.
    """
    return F.sha2(F.concat_ws("|", *[_token(df, f) for f in fields]), 256)


def payload_digest(line: Column | str) -> Column:
    """Digest of a JSON document that ignores key order, spacing and the spelling of numbers."""
    text = F.col(line) if isinstance(line, str) else line
    return document_digest(F.parse_json(text))


def document_digest(document: Column) -> Column:
    """The same of a document that has been parsed already, as a VARIANT."""
    return F.sha2(F.to_json(document), 256)


def stable_id(*parts: Column) -> Column:
    """A repeatable identifier, so that running a batch again makes the same record and not another."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts]), 256)
