"""Removing repeated passages of lines: overlapping windows of three consecutive lines.

Every three consecutive lines of every document are hashed to 128 bits. A window that occurs again, in whatever
document, keeps its first occurrence (by document id, then position); the lines of all later occurrences are covered,
overlapping and touching windows are merged to spans, and the spans are cut out. The first occurrence of a line can
only be covered by a window whose own first occurrence, and with it that line, comes earlier; so each distinct line
survives at least once.

Built-in column functions only. Windows are counted with partial aggregation, and the later ones are found by a join
with the table of repeated windows, which adaptive execution can split where one window fills a third of all rows.
What is grouped by document are positions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

SPAN = 3


def windows_of(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, row, pos, k1, k2: one row per window. Documents with fewer lines than ``span`` have none."""
    line = lambda i, k: F.element_at("lines", i + k + 1)
    hashed = lambda i: F.struct(
        i.alias("pos"), F.xxhash64(*[line(i, k) for k in range(span)]).alias("k1"),
        F.xxhash64(F.lit(span), *[line(i, k) for k in reversed(range(span))]).alias("k2"),
    )
    cut = rows.select("doc_id", "row", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= span)
    made = F.transform(F.sequence(F.lit(0), F.size("lines") - span), hashed)
    return cut.select("doc_id", "row", F.explode(made).alias("w")).select("doc_id", "row", "w.*")


def spans_of(windows: DataFrame, repeated: DataFrame, span: int = SPAN) -> DataFrame:
    """row and its sorted ``spans`` (first and last line, from 0): the merged later occurrences."""
    own = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "pos")
    later = windows.join(repeated, ["k1", "k2"]).where(own > F.col("first")).select("row", "pos")
    ordered = W.partitionBy("row").orderBy("pos")
    starts = later.withColumn("begins", F.coalesce(F.col("pos") - F.lag("pos").over(ordered) > span, F.lit(True)))
    numbered = starts.withColumn("no", F.sum(F.col("begins").cast("int")).over(ordered))
    merged = numbered.groupBy("row", "no").agg(F.min("pos").alias("a"), (F.max("pos") + span - 1).alias("b"))
    return merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per row of ``docs``: doc_id, text without later occurrences, n_lines, n_removed, spans.

    Lines end at line feeds. A null text stays null with 0 lines; an empty one has one empty line. Rows that repeat
    an id are told apart and ordered as read; null ids come last. Other columns are left out. ``spans`` is null
    where nothing is removed; a text of which all lines go becomes empty.
    """
    scratch = common.Scratch(docs.sparkSession, "line-dedup")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "rows")
    windows = scratch.keep(windows_of(rows, span), "windows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "pos")).alias("first")
    repeated = scratch.keep(windows.groupBy("k1", "k2").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    spans = scratch.keep(spans_of(windows, repeated, span), "spans")
    scratch.drop("windows", "repeated")
    lines, spans_col = F.split("text", "\n", -1), F.col("spans")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1)
    begins = F.concat(F.array(F.lit(0)), F.transform(spans_col, lambda s: s["b"] + 1))
    ends = F.concat(F.transform(spans_col, lambda s: s["a"]), F.array(F.size("lines")))
    parts = F.zip_with(begins, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    out = rows.join(spans, "row", "left").withColumn("lines", F.when(spans_col.isNotNull(), lines))
    return out.select(
        "doc_id", F.when(spans_col.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n")).alias("text"),
        n_lines.cast("long").alias("n_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_removed"), "spans",
    )
