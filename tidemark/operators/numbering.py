"""Dense numbers without a global window: surrogate keys and row numbers within files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row within the partition below


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` range partitioned and sorted by ``order``, written once, with its place: ``_part`` and ``_slot``.

    A part is a run of consecutive rows whose size Spark bounds by sampling; a key that holds a third of the
    rows spans many parts if ``order`` goes on after the key. The write freezes the bounds, which a second
    evaluation could sample differently.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return written(ranged, "ordered").withColumn("_part", F.shiftright("_slot", _SLOT_BITS))


def dense_number(df: DataFrame, order: Sequence[str], name: str, start: Column | int = 0) -> DataFrame:
    """Number the rows ``start + 1, start + 2, ...`` in ``order``, which must be unique.

    The offsets are running sums over one count per part. Nothing but that list of counts is ever in one place.
    """
    first = F.lit(start) if isinstance(start, int) else start
    slots = in_order(df, order)
    counts = slots.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_slot") - F.shiftleft("_part", _SLOT_BITS)
    return (
        slots.join(offsets, "_part")
        .withColumn(name, (first + F.col("_offset") + within + 1).cast("long"))
        .drop("_slot", "_part", "_offset")
    )


def rank_blocks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``df`` with ``block``: runs of at most ``size`` consecutive rows in ``order``, which must be unique, whatever its values.

    A block lies within a part of the range sort, so a row's block follows from its place in the part; no row has to be
    counted or joined for it. Later blocks have higher numbers.
    """
    slots = in_order(df, order)
    within = F.col("_slot") - F.shiftleft("_part", _SLOT_BITS)
    run = F.call_function("div", within, F.lit(size).cast("long"))
    return slots.withColumn("block", F.shiftleft("_part", _SLOT_BITS) + run).drop("_slot", "_part")


def number_file_rows(lines: DataFrame, name: str = "row_num", file: str = "file_path", split: str = "split_start") -> DataFrame:
    """Number the rows of each file from 1, in file order.

    One task reads a split from its start to its end, so a row's number within the split is its place in the task
    less the place of the split's first row. Each split adds the rows of the splits before it; these offsets, one
    row per split, are the only thing that is grouped, and they are written, so that Spark knows their size when it
    chooses the join. ``lines`` must come from the scan without an exchange; rows may have been dropped or exploded.
    """
    placed = lines.withColumn("_place", F.monotonically_increasing_id())
    spans = placed.groupBy(file, split).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(file).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(file, split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    numbered = placed.join(written(offsets, "offsets"), [file, split])
    return numbered.withColumn(name, F.col("_place") + F.col("_offset")).drop("_place", "_offset")
