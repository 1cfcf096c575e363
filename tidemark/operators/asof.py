"""As-of join: every row with the state of its key that was in force at the row's own time.

States and rows are put into one sequence, in the order of key and time, and cut into parts of bounded size. Within a
part a row takes the last state in front of it; what the parts before leave behind is one summary row per key and part.
There is no join on a range, so a key with many states and many rows costs what they are together and not their product,
and no key is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .numbering import in_order

_STATE, _ROW = 0, 1


def as_of(
    rows: DataFrame, states: DataFrame, key: str, at: str, since: str, take: Sequence[str], order: Sequence[str], until: str | None = None
) -> DataFrame:
    """``rows`` with the columns ``take`` of the last state that began at or before ``at``, null where there is none.

    Of states that began at the same time the one with the greatest ``order`` counts. With ``until`` a state that had ended by
    then, at that very moment or before, gives nulls. Rows without a key or a time find nothing and are kept.
    """
    began = states.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    given = [*take, *([until] if until else [])]
    held = began.select(
        F.col(key).alias("_key"), F.col(since).alias("_at"), F.lit(_STATE).alias("_kind"), F.struct(*order).alias("_order"),
        F.struct(*[F.col(c).alias(f"_{c}") for c in given]).alias("_state"),
    )
    asking = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(_ROW).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    both = in_order(held.unionByName(asking, allowMissingColumns=True), ["_key", "_at", "_kind", "_order"])

    last = both.where("_state is not null").groupBy("_key", "_part").agg(F.max_by("_state", "_slot").alias("_last"))
    spans = both.select("_key", "_part").distinct().join(last, ["_key", "_part"], "left")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("_key"), "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
    within = Window.partitionBy("_key", "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_within", F.last("_state", ignorenulls=True).over(within)).where(F.col("_kind") == _ROW)
    found = found.join(carried, ["_key", "_part"], "left").withColumn("_state", F.coalesce("_within", "_carried"))
    if until:
        ended = F.col(f"_state._{until}") <= F.col("_at")
        found = found.withColumn("_state", F.when(~F.coalesce(ended, F.lit(False)), F.col("_state")))
    return found.select("_row.*", *[F.col(f"_state._{c}").alias(c) for c in take])
