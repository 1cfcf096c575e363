"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal size with few neighbours apart. A
small classifier then learns, from a vector alone, in which parts its neighbours lie. It places every vector of the
table in its most probable part, and sends a query to several of its most probable parts, whose members are all
scored exactly. How many parts are visited follows from sample vectors that neither graph, parts nor classifier have
seen, both as queries and as neighbours: as many as hold ``COVERAGE`` of their true neighbours among them. A query
whose parts hold too few candidates goes on to further parts.

Only the sample (``SAMPLE`` vectors expected, drawn by hash) and the model are bounded and touch the driver. A part
is searched in blocks of members and blocks of queries, so no task holds more than a block of each, however full a
part is. Equal vectors are one member with the ids that can be among the nearest: with ``k`` nearest asked, no more
than the k + 1 smallest ids of equal vectors can. Equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

SAMPLE, MOST_PARTS, PER_PART, NEIGHBOURS, HIDDEN, EPOCHS = 8192, 64, 128, 16, 128, 40
COVERAGE, BLOCK = 0.95, 4096


class Model(NamedTuple):
    """A classifier with one hidden layer, and how many of its most probable parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return np.maximum(vectors @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def nearest_in(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others."""
    out = np.empty((len(vectors), k), np.int64)
    for start in range(0, len(vectors), 512):
        scores = vectors[start : start + 512] @ vectors.T
        scores[np.arange(len(scores)), np.arange(start, start + len(scores))] = -np.inf
        out[start : start + 512] = np.argpartition(scores, -k, axis=1)[:, -k:]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.05) -> np.ndarray:
    """A part for each node: equal halves along principal directions, then moves towards neighbours while there is room."""
    part = np.zeros(len(vectors), np.int64)
    for level in range(parts.bit_length() - 1):
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            centred = vectors[own] - vectors[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ direction, kind="stable")]
            part[order[len(order) // 2 :]] += 1 << level
    room, n = int(np.ceil(len(vectors) / parts * (1 + slack))), len(vectors)
    a = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int64)
        np.add.at(votes, (a, part[b]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for node in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            for target in np.argsort(-votes[node], kind="stable"):
                if votes[node, target] <= votes[node, part[node]]:
                    break
                if size[target] < room:
                    size[target] += 1
                    size[part[node]] -= 1
                    part[node], moved = target, moved + 1
                    break
        if not moved:
            break
    return part


def _trained(x: np.ndarray, y: np.ndarray) -> Model:
    """Softmax classifier of soft labels, by Adam from a fixed start."""
    rng = np.random.default_rng(17)
    shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, y.shape[1]), (y.shape[1],)]
    weights = [rng.standard_normal(s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in shape]
    first, second, step = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
    for epoch in range(EPOCHS):
        rate = 0.004 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            xs, ys = x[order[start : start + 256]], y[order[start : start + 256]]
            hidden = np.maximum(xs @ weights[0] + weights[1], 0)
            logits = hidden @ weights[2] + weights[3]
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (error / error.sum(axis=1, keepdims=True) - ys) / len(xs)
            back = (error @ weights[2].T) * (hidden > 0)
            slopes, step = [xs.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)], step + 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(*weights, visits=1)


def fit(sample: np.ndarray, k: int) -> Model:
    """Parts and their classifier from sample vectors (rows)."""
    n, parts = len(sample), 1
    while parts < MOST_PARTS and n // (2 * parts) >= PER_PART:
        parts *= 2
    if parts == 1:
        return Model(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    trained = np.random.default_rng(5).permutation(n) >= n // 8
    seen, unseen = sample[trained], sample[~trained]
    graph = nearest_in(seen, min(NEIGHBOURS, len(seen) - 1))
    part = balanced_parts(seen, graph, parts)
    soft = np.zeros((len(seen), parts))
    np.add.at(soft, (np.repeat(np.arange(len(seen)), graph.shape[1]), part[graph.ravel()]), 1)
    soft[np.arange(len(seen)), part] += 1
    model = _trained(seen, soft / soft.sum(axis=1, keepdims=True))
    # members outside the sample are placed as the unseen ones are, so only these count as neighbours
    placed, near = model.logits(sample).argmax(axis=1), nearest_in(sample, min(k, n - 1))[~trained]
    turn = np.argsort(np.argsort(-model.logits(unseen), axis=1), axis=1)  # when a query would visit each part
    visited = np.take_along_axis(turn, placed[near], axis=1)[~trained[near]]
    if not len(visited):
        return model._replace(visits=parts)
    covered = [(visited < visits).mean() for visits in range(1, parts + 1)]
    return model._replace(visits=1 + next(i for i, c in enumerate(covered) if c >= COVERAGE or i == parts - 1))


def taking_part(vector: str) -> Column:
    """Neither null nor zero, all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _placed(members: DataFrame, model: Model, visits: int, held: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """``u``, ``parts``: the ``visits`` most probable parts, or more, until they hold ``least`` ids; ``held``: ids a part."""
    shared = members.sparkSession.sparkContext.broadcast((model, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                model, held = shared.value
                order = np.argsort(-model.logits(_matrix(batch.column(1))), axis=1, kind="stable").astype(np.int32)
                most = np.full(len(order), visits)
                if held is not None:
                    most = np.maximum(most, 1 + (np.cumsum(held[order], axis=1) < least).sum(axis=1))
                lists = pa.array([parts[:n] for parts, n in zip(order, most)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["u", "parts"])

    return members.select("u", "v").mapInArrow(run, "u long, parts array<int>")


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float)


def _search(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 nearest ids of each query in one block of members; ties to smaller ids."""
    out = []
    if len(queries) and len(members):
        x, ids = np.stack(members["v"].to_numpy()), members["ids"].tolist()
        for start in range(0, len(queries), 256):
            q = np.stack(queries["v"].iloc[start : start + 256].to_numpy())
            scores = q @ x.T
            most = min(k + 1, len(x))
            line = np.partition(scores, -most, axis=1)[:, -most] - 1e-9 * np.abs(scores).max(axis=1)
            for i, u in enumerate(queries["u"].iloc[start : start + 256]):
                near = np.flatnonzero(scores[i] >= line[i])
                exact = np.einsum("ij,j->i", x[near], q[i])
                found = sorted((-s, vec_id) for s, n in zip(exact.tolist(), near.tolist()) for vec_id in ids[n])
                out += [(u, vec_id, -s) for s, vec_id in found[: k + 1]]
    return pd.DataFrame(out, columns=["u", "vec_id", "score"]).astype({"u": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row that ``queries`` selects.

    Nearness is the largest inner product in double precision on the original vectors, ties to the smaller id. The
    candidates of a query are all rows with another id. Rows with a null id, or vectors that are null, zero, hold
    null or non-finite components, or are not as long as most, take no part. Rows that repeat id and vector count
    once. Fewer candidates than k are all returned; no rows give no rows. Other columns are left out.
    """
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    scratch = common.Scratch(spark, "ann")
    rows = vectors.where(taking_part(vector) & F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "length")).alias("most")).first()["most"]
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = scratch.keep(rows.where(F.size("v") == usual["length"]).distinct(), "rows")
    least = W.partitionBy("v").orderBy("vec_id")
    members = rows.select("v", "vec_id").distinct().withColumn("no", F.row_number().over(least)).where(F.col("no") <= k + 1)
    members = members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    members = scratch.keep(members.withColumn("u", F.monotonically_increasing_id()), "members")

    n = members.count()
    drawn = F.pmod(F.xxhash64("u", F.lit(3)), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)
    sample = members.where(drawn).select("u", "v").toArrow().sort_by("u")
    model = fit(_matrix(sample["v"].combine_chunks()) if sample.num_rows else np.zeros((1, usual["length"])), k)

    placed = _placed(members, model, 1).select("u", F.col("parts")[0].alias("part"))
    index = scratch.keep(members.join(placed, "u"), "index")
    asking = rows.where("asks").join(members.select("u", "v"), "v").select(F.col("vec_id").alias("query_id"), "u").distinct()
    asking = scratch.keep(asking, "asking")
    asked = members.join(asking.select("u").distinct(), "u", "left_semi").select("u", "v")
    held = np.zeros(model.w2.shape[1], np.int64)  # one row per part comes to the driver
    for r in index.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["part"]] = r["n"]
    visits = scratch.keep(asked.join(_placed(asked, model, model.visits, held, k + 1), "u").select("u", "v", F.explode("parts").alias("part")), "visits")

    # blocks per part, for members and for queries: one row per part, at most MOST_PARTS
    size = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    size = size.join(visits.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "part")
    size = F.broadcast(spark.createDataFrame([tuple(r) for r in size.collect()], "part int, blocks int, chunks int"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = lambda count: F.pmod(F.xxhash64("u", F.lit(9)), F.col(count)).cast("int")
    left = visits.join(size, "part").select("u", "v", "part", every("blocks").alias("block"), one("chunks").alias("chunk"))
    right = index.join(size, "part").select("v", "ids", "part", one("blocks").alias("block"), every("chunks").alias("chunk"))
    key = ["part", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: _search(a, b, k), "u long, vec_id long, score double")
    nearest = W.partitionBy("u").orderBy(F.desc("score"), "vec_id")
    found = scratch.keep(found.withColumn("no", F.row_number().over(nearest)).where(F.col("no") <= k + 1).drop("no"), "found")

    ranked = W.partitionBy("query_id", "u").orderBy(F.desc("score"), "vec_id")
    answers = asking.join(found, "u").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked))
    return answers.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
