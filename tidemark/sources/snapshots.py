"""Core snapshots: JSON objects, in an array or bare, one or several to a line, or pretty-printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import row_digest
from ..operators.numbering import number_file_rows
from ..schemas import SNAPSHOT_FIELDS, SNAPSHOT_HASHES, TYPES
from .files import lines

# A text between the brackets around the array and the commas between its lines; matched as a whole, so that one attempt decides.
_BETWEEN = r"(?s)^\s*+\[?+\s*+(.*[^\s,\]])?\s*+,?+\s*+\]?+\s*+$"


#: Stands behind the last object of a text, so that text left over after it is noticed.
_END = "<end of text>"


def read_snapshot(
    spark: SparkSession, paths: list[str], fields: tuple[str, ...], extra: tuple[str, ...] = (), layout: str = "lines"
) -> DataFrame:
    """Objects of the snapshot as text columns, with ``raw_json``, file_path, file_name and row_num (from 1).

    ``layout="lines"`` keeps a file splittable: every line holds whole objects, any number of them, with or without
    the array's brackets and commas. ``layout="document"`` reads a document that is spread over several lines, one
    file per task. Every object of a text is read; text that is not one, or is left over, fails the read by file.
    ``raw_json`` is the text as delivered where it holds one object, else the object written anew.
    """
    if layout not in ("lines", "document"):
        raise ValueError(f"unknown layout {layout!r}")
    text = lines(spark, paths, whole=layout == "document").withColumn("value", F.regexp_replace("value", _BETWEEN, "$1"))
    # a column of its own, as everything below asks for it: a text is parsed once for each time it is read
    text = text.withColumn("items", F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(f',"{_END}"]'))).try_cast("array<variant>"))
    items = F.col("items")
    objects = F.slice(items, 1, F.size(items) - 1)
    whole = F.try_element_at(items, F.lit(-1)).try_cast("string").eqNullSafe(F.lit(_END)) & F.forall(
        objects, lambda o: F.coalesce(F.schema_of_variant(o), F.lit("")).startswith("OBJECT"))
    refused = F.raise_error(F.concat(F.lit("Not a sequence of whole JSON objects: a text of "), F.col("file_name")))
    # nothing between the brackets is no object; said here, as Spark may move a filter behind the check
    checked = F.when(F.coalesce(whole, F.lit(False)), objects).when(F.col("value") == "", F.array().cast("array<variant>"))
    checked = checked.otherwise(refused.cast("array<variant>"))
    # Exploded as an expression: for a column Spark would add a filter that evaluates the check again. The text goes with
    # its object only if that is the only one; else every object would carry the whole text.
    parsed = text.withColumn("alone", F.when(F.size(items) == 2, F.col("value"))).select(
        "file_path", "file_name", "split_start", "alone", F.explode(checked).alias("doc"))
    raw = F.coalesce("alone", F.to_json("doc"))
    numbered = number_file_rows(parsed.withColumn("raw_json", raw).drop("alone"))
    columns = [F.try_variant_get("doc", f"$.{f}", "string").alias(f) for f in (*fields, *extra)]
    return numbered.select(*columns, "raw_json", "file_path", "file_name", "row_num")


def with_fallback(df: DataFrame, column: str, other: str) -> DataFrame:
    """``column``, or where it is missing or empty, ``other``."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.nullif(F.col(other), F.lit("")))).drop(other)


def typed(raw: DataFrame, name: str, batch_id: Column, at: Column) -> DataFrame:
    """The staging form of a snapshot. Casts are strict: a bad value fails the batch."""
    cast = raw.select(
        *[F.col(f).cast(TYPES.get(f, "string")).alias(f) for f in SNAPSHOT_FIELDS[name]],
        *[c for c in ("file_name", "row_num") if c in raw.columns],
    )
    return cast.withColumns({
        "row_hash": row_digest(cast, SNAPSHOT_HASHES[name]), "batch_id": batch_id, "staged_at": at,
    })
