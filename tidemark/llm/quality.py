"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is the TF-IDF vector of its character trigrams, as written, and of its character-class 4-grams; a truncated
singular value decomposition of a bounded labelled sample gives the latent space. The labelled vectors of a larger
bounded sample are broadcast. For every document the cosine with every labelled vector is computed exactly, in blocks
of matrix products; the ``k`` nearest vote with their labels, weighted by similarity and by how thinly their label was
sampled, so that votes reflect the labels' true shares.

Only the labelled samples are bounded (``voters`` and ``basis_rows``, drawn by a hash of the id); inverse document
frequencies are counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, grams

BITS, VOTERS, BASIS_ROWS, RANK, NEIGHBOURS, SHARPNESS = 12, 6000, 2000, 64, 25, 4


class Model(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray  # size x rank
    voters: np.ndarray  # unit rows
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def _basis(rows: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular directions, by subspace iteration from a fixed start."""
    rank = min(rank, *rows.shape)
    q = np.linalg.qr(rows.T @ np.random.default_rng(11).standard_normal((len(rows), min(rank + 16, len(rows)))).astype(np.float32))[0]
    for _ in range(5):
        q = np.linalg.qr(rows.T @ (rows @ q))[0]
    inner = np.linalg.svd(rows @ q, full_matrices=False)[2]
    return (q @ inner[:rank].T).astype(np.float32)


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        voters: int = VOTERS, basis_rows: int = BASIS_ROWS, rank: int = RANK, bits: int = BITS) -> Model:
    """Learn from the rows of ``labels`` (ids with 0 or 1); the caller leaves out what must not be learned from.

    Labels that are null or neither 0 nor 1 are passed over; of an id's labels the lowest counts, of its texts the
    least. Half of the voters, if there are as many, have either label. Without labels every score is 0.5.
    """
    spark, size = docs.sparkSession, (1 << bits) + 4096
    common.bounded_batches(spark)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = lambda value: grams.surface_counts(value, bits)
    idf = grams.inverse_frequencies(texts, "text", size, count)
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().where("label in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    empty = Model(idf, np.zeros((size, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0), 0.5)
    if not sizes:
        return empty
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, voters / len(sizes) / n)])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.element_at(share, F.col("label")) * (1 << 30)
    # about ``voters`` rows of two numbers, whatever the input
    sample = texts.join(F.broadcast(marked.where(drawn)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams.weighted(count(t)[None, :], idf)[0] for t in batch.column(1).to_pylist()]
            used = [np.flatnonzero(v) for v in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())),
                pa.array([v[u] for v, u in zip(found, used)], pa.list_(pa.float32())),
            ], names=["doc_id", "label", "at", "value"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = sample.mapInArrow(sparse, f"doc_id {kind}, label int, at array<int>, value array<float>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return empty
    label_of = rows["label"].to_numpy().astype(float)
    order = np.random.default_rng(3).permutation(len(label_of))

    def dense(numbers) -> np.ndarray:
        block = np.zeros((len(numbers), size), np.float32)
        for i, n in enumerate(numbers):
            block[i, rows["at"][int(n)].values.to_numpy()] = rows["value"][int(n)].values.to_numpy()
        return block

    basis = _basis(dense(order[:basis_rows]), rank)
    latent = np.concatenate([dense(order[s : s + 256]) @ basis for s in range(0, len(order), 256)])
    kept = {y: max(1, int((label_of == y).sum())) for y in sizes}
    weights = np.array([sizes[int(y)] / kept[int(y)] for y in label_of[order]])
    prior = sizes.get(1, 0) / sum(sizes.values())
    return Model(idf, basis, _units(latent), label_of[order], weights, prior)


def _scores(counts: np.ndarray, model: Model, k: int) -> np.ndarray:
    latent = _units(grams.weighted(counts, model.idf) @ model.basis)
    out = np.full(len(latent), model.prior)
    if not len(model.voters):
        return out
    cosines = latent @ model.voters.T
    k = min(k, cosines.shape[1])
    near = np.argpartition(cosines, -k, axis=1)[:, -k:]
    votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** SHARPNESS * model.weights[near]
    total = votes.sum(axis=1)
    known = (total > 0) & latent.any(axis=1)
    out[known] = (votes * model.labels[near]).sum(axis=1)[known] / total[known]
    return np.clip(out, 0, 1)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with the probability-like vote for label 1 (replacing a column of that name); no shuffle.

    Empty, null and very short texts have no gram and get the share of label 1 among all labels.
    """
    common.bounded_batches(docs.sparkSession)
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), int(len(model.idf) - 4096).bit_length() - 1

    @F.arrow_udf("double")
    def voted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for start in range(0, len(texts), 256):
                out.append(_scores(np.array([grams.surface_counts(t or "", bits) for t in texts[start : start + 256]]), shared.value, k))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn(into, voted(F.col(text)))
