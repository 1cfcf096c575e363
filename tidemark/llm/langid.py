"""Language identification by nearest centroids.

A text is the normalised TF-IDF vector of its letter trigrams. For each language, the vectors of a bounded sample of
labelled texts are clustered (spherical k-means) to several centroids, since one language is written in several ways.
A text gets the language of the centroid with the largest cosine. It is rejected if even that one is far away:
below half of what all but a thousandth of the sample reach, or if the text has no letter.

Inverse document frequencies are counted over all documents that may be learned from; only the sample is bounded
(``per_language`` texts expected of each, drawn by a hash of the id). Clustering runs per language on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, grams

BITS, PER_LANGUAGE, CENTROIDS, ROUNDS = 13, 500, 8, 10
UNKNOWN = "und"


class Model(NamedTuple):
    idf: np.ndarray
    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    least: float  # a smaller cosine is rejected


def _clustered(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit vectors, by cosine. Starts far apart: each next seed is the vector worst covered so far."""
    seeds = [vectors.mean(axis=0)]
    for _ in range(min(k, len(vectors)) - 1):
        seeds.append(vectors[int(np.argmin((vectors @ np.array(seeds).T).max(axis=1)))])
    centroids = np.array(seeds)
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        nearest = (vectors @ centroids.T).argmax(axis=1)
        for c in set(nearest.tolist()):
            centroids[c] = vectors[nearest == c].mean(axis=0)
    return (centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE, k: int = CENTROIDS, bits: int = BITS) -> Model:
    """Learn from all rows of ``docs``; the caller leaves out what must not be learned from.

    Rows with a null id, text or language are passed over. Of rows that repeat an id and language one is learned
    from. Without any row there is no language, and every text is unknown.
    """
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    count = lambda value: grams.letter_counts(value, bits)
    idf = grams.inverse_frequencies(rows, "text", 1 << bits, count)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros(0, int), np.zeros((0, 1 << bits), np.float32), 0.0)
    share = F.create_map(*[F.lit(x) for item in ((name, per_language / n) for name, n in sizes.items()) for x in item])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    sample = rows.where(drawn).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def centroids_of(frame: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(count, frame["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "cosines": []})
        vectors = grams.weighted(np.array(counts), idf)
        made = _clustered(vectors, k, ROUNDS)
        reached = (vectors @ made.T).max(axis=1).tolist()
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": list(made), "cosines": [reached] + [[]] * (len(made) - 1)})

    made = sample.groupBy("lang").applyInPandas(centroids_of, "lang string, centroid array<float>, cosines array<double>").collect()
    made.sort(key=lambda r: (r["lang"], -len(r["cosines"])))
    languages = sorted({r["lang"] for r in made})
    reached = [c for r in made for c in r["cosines"]]
    least = float(np.quantile(reached, 0.001)) / 2 if reached else 0.0
    owner = np.array([languages.index(r["lang"]) for r in made], int)
    return Model(idf, languages, owner, np.array([r["centroid"] for r in made], np.float32).reshape(len(made), 1 << bits), least)


def _judged(counts: list[np.ndarray | None], model: Model) -> list[dict]:
    """Language, score, distance and rejection of each text's counts."""
    out = [{"lang_pred": UNKNOWN, "score": 0.0, "distance": 1.0, "rejected": True} for _ in counts]
    known = [i for i, c in enumerate(counts) if c is not None]
    if not known or not model.languages:
        return out
    cosines = grams.weighted(np.array([counts[i] for i in known]), model.idf) @ model.centroids.T
    best = np.stack([cosines[:, model.owner == n].max(axis=1) for n in range(len(model.languages))], axis=1)
    best = np.clip(best, 0, 1).astype(float)
    for i, row in zip(known, best):
        winner, total = int(row.argmax()), row.sum()
        out[i] = {
            "lang_pred": model.languages[winner], "score": float(row[winner] / total) if total else 0.0,
            "distance": float(1 - row[winner]), "rejected": bool(row[winner] < model.least or not total),
        }
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, distance and rejected (replacing columns of these names); no shuffle.

    Null texts and texts without letters are ``und``, score 0, rejected. The nearest language is named even where
    the distance rejects. Ties go to the language first by name.
    """
    common.bounded_batches(docs.sparkSession)
    shared, bits = docs.sparkSession.sparkContext.broadcast(model), int(len(model.idf)).bit_length() - 1
    kind = "lang_pred string, score double, distance double, rejected boolean"

    @F.arrow_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("distance", pa.float64()), ("rejected", pa.bool_())])
        for batch in batches:
            rows, texts = [], batch.to_pylist()
            for start in range(0, len(texts), 256):
                rows += _judged([grams.letter_counts(t or "", bits) for t in texts[start : start + 256]], shared.value)
            yield pa.array(rows, fields)

    others = [c for c in docs.columns if c not in ("lang_pred", "score", "distance", "rejected", "_judged")]
    return docs.select(*others, judged(F.col(text)).alias("_judged")).select(*others, "_judged.*")
