"""Connected components of a link table, on the executors.

Alternating star contraction: every node hands its larger neighbours to its least neighbour, then its smaller ones,
until only stars are left. A round is two joins with a minimum per node; minima are combined on the map side, and a
node that holds a third of all links is split by adaptive execution, as both sides of the joins are written tables.
The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _all_stars(links: DataFrame) -> bool:
    """Whether every node that points somewhere points once, and nothing points at it."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def stars(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b) but the roots themselves; root is the least node."""
    now, turn = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0
    now = scratch.keep(now, f"{label}-0")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-{turn}-a")
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = scratch.keep(larger, f"{label}-{turn}-b")
        least = scratch.keep(larger.groupBy("u").agg(F.min("v").alias("m")), f"{label}-{turn}-c")
        smaller = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(smaller.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"{label}-{turn + 1}")
        scratch.drop(f"{label}-{turn}", *[f"{label}-{turn}-{part}" for part in "abc"])
        now, turn = after, turn + 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
