"""Comparing two versions of a table by fingerprints.

A bucket's fingerprint is the number of its rows and two sums of row hashes: it does not depend on order, counts repeated rows, and is
an ordinary aggregate, so rows are read once, narrowed to two numbers where they are, and never sorted. Only buckets whose
fingerprints differ are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def _image(df: DataFrame) -> Column:
    """The row as one value that can be hashed: columns by name, nulls told from texts. Maps appear as sorted entries."""
    plain = [F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in sorted(df.dtypes)]
    return F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})


def fingerprints(df: DataFrame, bucket: Column) -> DataFrame:
    """bucket, rows, f1, f2: one row per bucket that has rows."""
    image = _image(df)
    hashes = df.select(bucket.alias("bucket"), F.xxhash64(image).alias("a"), F.xxhash64(F.lit(1), image).alias("b"))
    return hashes.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.sum(F.col("a").cast("decimal(20,0)")).alias("f1"), F.sum(F.col("b").cast("decimal(20,0)")).alias("f2"))


def compared_buckets(before: DataFrame, after: DataFrame, bucket: Column) -> DataFrame:
    """bucket, rows_before, rows_after, equal. Buckets that are empty on both sides do not appear."""
    old = fingerprints(before, bucket).withColumnsRenamed({"rows": "rows_before", "f1": "b1", "f2": "b2"})
    new = fingerprints(after, bucket).withColumnsRenamed({"rows": "rows_after", "f1": "a1", "f2": "a2"})
    zero = F.lit(0).cast("long")
    same = F.col("b1").eqNullSafe(F.col("a1")) & F.col("b2").eqNullSafe(F.col("a2")) & F.col("rows_before").eqNullSafe(F.col("rows_after"))
    return old.join(new, "bucket", "full_outer").select(
        "bucket", F.coalesce("rows_before", zero).alias("rows_before"), F.coalesce("rows_after", zero).alias("rows_after"), same.alias("equal"))


def differing_rows(before: DataFrame, after: DataFrame, bucket: Column, compared: DataFrame | None = None) -> DataFrame:
    """The rows that one side has more often than the other, with ``bucket``, ``side`` (lost or added) and ``times``.

    Only rows of buckets with different fingerprints are looked at; ``compared`` may hold a result of
    ``compared_buckets`` that was kept.
    """
    compared = compared_buckets(before, after, bucket) if compared is None else compared
    suspects = compared.where(~F.col("equal")).select("bucket")

    def chosen(df: DataFrame, sign: int) -> DataFrame:
        rows = df.withColumns({"bucket": bucket, "_image": _image(df)}).join(suspects, "bucket", "left_semi")
        return rows.select("bucket", "_image", F.lit(sign).alias("_sign"), F.struct(*df.columns).alias("_row"))

    both = chosen(before, -1).unionByName(chosen(after.select(*before.columns), 1))
    left = both.groupBy("bucket", "_image").agg(F.sum("_sign").alias("_n"), F.any_value("_row").alias("_row")).where("_n <> 0")
    side = F.when(F.col("_n") < 0, "lost").otherwise("added").alias("side")
    return left.select("bucket", side, F.abs("_n").alias("times"), "_row.*")
