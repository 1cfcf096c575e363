"""The pipeline against a plain version: the classifiers' decisions row by row, brute force for the rest."""

import os
import re

import pytest
from test_operators_llm import brute_components, check_packed

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import common, grams, langid, quality
from tidemark.llm.queries import QUALITY_LINE, learned_languages, learned_quality

TABLES = "/root/testdata/sf0.001"
BLANKS = re.compile("[\x20\x09-\x0d]+")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_run_equals_the_plain_version(spark):
    docs = common.table(spark, TABLES, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = learned_quality(docs, TABLES)
    counts = grams.surface_counts
    bits = (len(model.idf) - 4096).bit_length() - 1
    rows = [r for r in rows if quality._scores(counts(r[1] or "", bits)[None, :], model, quality.NEIGHBOURS)[0] >= QUALITY_LINE]
    left = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    languages = learned_languages(left)
    rows = [r for r in rows if not langid._judged([grams.letter_counts(r[1] or "", langid.BITS)], languages)[0]["rejected"]]
    first = {}
    for i, text in sorted(rows):
        first.setdefault(BLANKS.sub(" ", text), (i, text))
    rows = list(first.values())
    components = brute_components(rows, 5, 80)
    kept = {int(c) for _, _, c in components} | {int(i) for i, n, _ in components if n == 0}
    rows = [r for r in rows if r[0] in kept]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    check_packed(corpus_pipeline.run(spark, TABLES).collect(), rows)


def test_stages_keep_the_columns(spark):
    docs = common.table(spark, TABLES, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), TABLES).columns == docs.columns, name
        assert stage(spark, docs.limit(0), TABLES).count() == 0, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]


def test_a_stage_leaves_what_an_earlier_result_reads(spark):
    docs = common.table(spark, TABLES, "documents")
    first = corpus_pipeline.drop_copies(spark, docs, TABLES)
    chained = corpus_pipeline.drop_near_copies(spark, first, TABLES)
    beside = corpus_pipeline.drop_near_copies(spark, docs, TABLES)
    assert first.count() > chained.count() > 0
    assert {r.doc_id for r in chained.select("doc_id").collect()} == {r.doc_id for r in beside.select("doc_id").collect()}


def test_runs_in_one_session_with_awkward_rows(spark, tmp_path):
    docs = common.table(spark, TABLES, "documents").limit(60)
    odd = docs.limit(4).withColumn("text", F.expr("element_at(array(null, '', ' ', '!?'), cast(doc_id % 4 as int) + 1)")).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    mixed = docs.unionByName(odd).unionByName(docs.limit(5)).withColumn("row", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n_shingles", F.lit(None).cast("string"))
    mixed.write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(os.path.join(TABLES, "labels.parquet"))
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    rows = sorted(map(tuple, one.select("doc_id", "start", "length").collect()))
    assert rows and rows == sorted(map(tuple, two.select("doc_id", "start", "length").collect()))
    ids = [r[0] for r in rows if r[1] == 0]
    assert len(ids) == len(set(ids))
