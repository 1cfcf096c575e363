"""First and last row per key, keyed inserts, upserts and deletes.

Per-key picks are aggregates, not windows. Spark combines them on the map side, so a key that holds a
third of all rows reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None, best) -> DataFrame:
    rest = [c for c in (keep if keep is not None else df.columns) if c not in keys and c not in order]
    packed = df.groupBy(*keys).agg(best(F.struct(*order, *rest)).alias("_row"))
    out = [c for c in df.columns if c in keys or c in rest or (c in order and (keep is None or c in keep))]
    return packed.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in out])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    return _pick(df, keys, order, keep, F.max)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one with the smallest ``order``."""
    return _pick(df, keys, order, keep, F.min)


_SLICES = 4096


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``rows``, whose key may be badly skewed, to a ``lookup`` that is unique on the key.

    Spark broadcasts the lookup when its measured size allows. Beyond that it is a sort-merge join, in which
    adaptive execution splits the oversized partitions of ``rows``. It can do so only if both sides end in a
    join exchange, and an aggregated lookup would not: it is partitioned by the key already. Joining on a hash
    of the key as well asks for a new partitioning on both sides and changes nothing in the result.
    """
    part = F.pmod(F.hash(*on), F.lit(_SLICES))
    return rows.withColumn("_slice", part).join(lookup.withColumn("_slice", part), [*on, "_slice"], how).drop("_slice")


def absent_from(rows: DataFrame, target: DataFrame, keys: Sequence[str], candidates: DataFrame | None = None) -> DataFrame:
    """The rows whose key ``target`` does not hold.

    The target is cut down to the keys in question first. An anti join could only broadcast or shuffle all of
    it; the semi join broadcasts the keys of a small batch instead, and shuffles the target only for a large one.
    ``candidates`` may name a cheaper source of the keys of ``rows``.
    """
    asked = (rows if candidates is None else candidates).select(*keys).distinct()
    held = target.select(*keys).join(asked, list(keys), "left_semi")
    return rows.join(held, list(keys), "left_anti")


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows to append: the first writer of every key that ``target`` does not hold yet."""
    first = earliest_by(incoming, keys, order)
    return absent_from(first, target, keys, incoming).select(*incoming.columns)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], updated: Sequence[str]) -> DataFrame:
    """``target`` after the upsert. A matched row takes only the ``updated`` columns from ``incoming``."""
    old, new = target.alias("old"), incoming.alias("new")
    joined = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")
    is_new = F.col(f"old.{keys[0]}").isNull()
    touched = F.col(f"new.{keys[0]}").isNotNull()

    def column(name: str) -> Column:
        mine, theirs = F.col(f"old.{name}"), F.col(f"new.{name}")
        return F.when(touched if name in updated else is_new, theirs).otherwise(mine).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
