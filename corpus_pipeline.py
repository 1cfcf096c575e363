"""The corpus pipeline: from raw documents to packed training sequences, one dealt operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what a stage returns as Parquet into
the shared folder and reads it back as the next stage's documents. All stages but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

import os
import time
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, jaccard, langid, packing, quality
from tidemark.llm.queries import QUALITY_LINE, learned_languages, learned_quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below the line go. Texts without any gram have the score of the prior."""
    scored = quality.score(docs, learned_quality(docs, sf_dir), into="quality_score")
    return scored.where(F.col("quality_score") >= QUALITY_LINE).select(*docs.columns)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or far from every known language go."""
    judged = langid.identify(docs, learned_languages(docs))
    return judged.where(~F.col("rejected")).select(*docs.columns)


#: Scratch folders of stages with the time they were made: those of the run at hand, or of stages called on their own.
_of_run: ContextVar[list | None] = ContextVar("scratch folders of a run", default=None)
_alone: list[tuple[common.Scratch, float]] = []


def _scratch(spark: SparkSession, docs: DataFrame, label: str) -> common.Scratch:
    """A stage's own scratch folder, which its result reads until it is written. ``run`` drops it then. A stage called on its own
    drops folders of earlier stages only if its documents were written after them and read none of their files."""
    made, held = common.Scratch(spark, label), _of_run.get()
    if held is None:
        held, files = _alone, docs.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
            written = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1000
            for before, since in list(_alone):
                if since < written and not any(os.path.basename(before.root) in file for file in files):
                    before.spark = spark  # the session may be another one by now
                    before.drop()
                    _alone.remove((before, since))
    held.append((made, time.time()))
    return made


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, up to white space, the row with the smallest id stays."""
    return exact_dedup.kept_rows(docs, scratch=_scratch(spark, docs, "exact-dedup"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 80 %): of each group of linked documents the one with the smallest id stays."""
    return jaccard.kept_rows(docs, scratch=_scratch(spark, docs, "near-dedup"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents that are left, with their ids."""
    _scratch(spark, docs, "packing")
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("language", keep_identified),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: The classifiers cannot be said in SQL; tests compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate results are tables in the shared folder.

    The table that packing reads stays for the returned frame; all others go as soon as the next one is written. Runs in one session
    do not touch each other's tables. Null and empty texts, repeated rows and extra columns are as each operator states
    them; an empty table gives no rows.
    """
    scratch, held = common.Scratch(spark, "corpus-pipeline"), []
    token = _of_run.set(held)
    try:
        docs = common.table(spark, sf_dir, "documents")
        for number, (name, stage) in enumerate(STAGES[:-1]):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
            while held:
                held.pop()[0].drop()
            if number:
                scratch.drop(STAGES[number - 1][0])
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _of_run.reset(token)
