"""Documents whose word n-gram sets have a Jaccard similarity of at least a threshold: a parity-sketch join.

Each shingle flips one bit of a sketch, so a bit is the parity of the shingles that fall on it. The XOR of two
sketches is the sketch of the symmetric difference; their Hamming distance cannot exceed its size. A similarity of p %
bounds that size by d = (|A| + |B|) (100 - p) / (100 + p).

Candidates. Sizes are banded so that partners lie in one band or the next. For each band the sketch is cut into more
than d blocks; a block's parities are kept as the XOR of the 64-bit codes of its set bits. Two sets that differ in at
most d shingles differ in at most d blocks, so some block is equal (pigeonhole), and equal blocks are found by an
equi-join. Blocks without a shingle would be equal for many unrelated documents. There are therefore ``spare`` more
blocks than needed: a document with at most ``spare`` empty blocks leaves them out, as then two partners still share
a block that is not empty; a document with more of them emits them as well, and finds the others like it.

Groups of copies. Equal sets are one node. Nodes are then linked in rounds: in each block the node that comes first in
a round's hash order is the hub, each node is verified against the hub with which it shares most blocks, and links
are contracted to components; blocks that are left with one component are done. After a few rounds all pairs are
formed that are in different components, agree in size and have sketches of 512 bits no further apart than d, each pair in
the first block it shares only: none is left out, and few are left. Each pair is verified on the whole sets. So the result is exact, up to equal 64-bit hashes of different shingles.

Blocks outnumber documents by far. Their keys are therefore written in ``KEY_PASSES`` columns by key value, and the keys
that recur are looked for column by column: equal keys are in the same pass, so nothing is lost, and the shuffles of
all blocks never lie on the disks together. Sets are compared in the same way: they are written in ``SET_PASSES``
columns by hash value, and a pair carries from pass to pass how many differing shingles it may still have. A pair that
has none left goes, so most wrong pairs move the first part of a set only, and no pair ever moves a whole one at once.

Sets take several times the room of the sketches, and the share of documents that meet some other one in a block grows with
the corpus. They are therefore made anew in each round, and only of the nodes of pairs that sizes and sketches allow. A sketch
of 512 bits cannot tell large sets apart; these have a second one with a bit for each shingle at least.

Joins of the blocks, texts and sets ask for a merge join: none of their sides is bounded, so the plan is the same at
every size, and adaptive execution can still split a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, components

WORDS_HELD = 250_000
SKETCH_BITS = 512
#: Rounds of links to hubs, each some twenty small jobs; they end sooner where a round after the second finds no link.
HUB_ROUNDS = 4
#: Block keys are dealt into so many passes by their value; what one pass shuffles is gone before the next begins.
KEY_PASSES = 4
#: Sets are dealt into so many parts by hash value and compared part by part; the shuffle of one part goes before the next.
SET_PASSES = 4

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes, with a cache of word hashes per worker."""

    def __init__(self, size: int):
        self.size, self.known = size, {}
        self.odd = [int(_ODD[j % len(_ODD)]) + 2 * (j // len(_ODD)) for j in range(max(size, 1))]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at 0x20, 0x09-0x0D only
        if len(self.known) > WORDS_HELD:
            self.known.clear()
        try:
            w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            self.known.update((word, xxhash.xxh64_intdigest(word)) for word in set(words) if word not in self.known)
            w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(w):
            return w
        n = min(self.size, len(w))
        total = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            total += _mixed(w[j : len(w) - n + 1 + j]) * np.uint64(self.odd[j] & 0xFFFFFFFFFFFFFFFF)
        return np.unique(_mixed(total))


@lru_cache(maxsize=4)
def shingler(size: int) -> Shingler:
    return Shingler(size)


@lru_cache(maxsize=8)
def band_starts(percent: int, top: int = 1 << 40) -> list[int]:
    """Least size of each band: a partner of a set in one band is in it or in a neighbouring one."""
    starts = [1]
    while starts[-1] < top:
        starts.append(max(starts[-1] + 1, starts[-1] * 100 // percent + 1))
    return starts


def most_different(total: int, percent: int) -> int:
    """The largest symmetric difference of two similar sets with ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def blocks_of_band(band: int, percent: int) -> tuple[int, int]:
    """(blocks, spare) of a band; no blocks if only equal sets are similar."""
    starts = band_starts(percent)
    least, need = max(1, starts[band] * percent // 100), most_different(2 * (starts[band + 1] - 1), percent) + 1
    if need == 1:
        return 0, 0
    spare = 2 + int(np.ceil(2 * need * np.exp(-least / need)))
    return need + spare, spare


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set's sketch blocks, in its own band and as the smaller partner in the next one."""
    starts = band_starts(percent)
    band = int(np.searchsorted(starts, len(shingles), side="right")) - 1
    codes, out = _mixed(shingles * _ODD[0]), []
    for at in (band, band + 1):
        blocks, spare = blocks_of_band(at, percent)
        if not blocks or (at > band and len(shingles) * 100 // percent < starts[at]):
            continue
        block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending, as the hashes are
        first = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
        used, parity = block[first], np.bitwise_xor.reduceat(codes, first)
        if blocks - len(used) > spare:
            missing = np.setdiff1d(np.arange(blocks, dtype=np.uint64), used)
            used, parity = np.concatenate([used, missing]), np.concatenate([parity, np.zeros(len(missing), np.uint64)])
        place = (used + np.uint64(1)) * _ODD[1] + np.full(1, at, np.uint64) * _ODD[2]
        out.append(_mixed(parity ^ _mixed(place)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity_sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """``bits`` parities as 64-bit integers. The XOR of the two halves is the sketch of half as many bits."""
    flips = np.bincount((_mixed(shingles * _ODD[3]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """A sketch with a bit for each shingle at least; empty if the one of 512 bits has them. In that one, half of the bits differ
    for any two sets of over a thousand shingles, which is no more than similar sets may differ by."""
    return parity_sketch(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > SKETCH_BITS else np.zeros(0, np.int64)


def _sketched(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, digest of the set, sketch, wide sketch and the join keys of each pass of (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shingler(size)
        for batch in batches:
            sets = [cut(value or "") for value in batch.column(2).to_pylist()]
            keys = [block_keys(s, percent) if len(s) else np.zeros(0, np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([parity_sketch(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([wide_sketch(s) for s in sets], pa.list_(pa.int64())),
                *[pa.array([k[k % np.uint64(KEY_PASSES) == g].view(np.int64) for k in keys], pa.list_(pa.int64())) for g in range(KEY_PASSES)],
            ], names=["row", "doc_id", "n_shingles", "digest", "sketch", "wide", *columns])

    kind, columns = dict(rows.dtypes)["doc_id"], [f"keys_{g}" for g in range(KEY_PASSES)]
    made = f"row long, doc_id {kind}, n_shingles long, digest binary, sketch array<long>, wide array<long>, " + ", ".join(f"{c} array<long>" for c in columns)
    return rows.select("row", "doc_id", "text").mapInArrow(run, made)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """node and the shingles of each pass of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, ends = shingler(size), np.array([((g + 1) << 64) // SET_PASSES - 1 for g in range(SET_PASSES - 1)], np.uint64)
        for batch in batches:
            parts = [np.split(s.view(np.int64), np.searchsorted(s, ends, side="right")) for s in (cut(value or "") for value in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([p[g] for p in parts], pa.list_(pa.int64())) for g in range(SET_PASSES)],
            ], names=["node", *columns])

    columns = [f"shingles_{g}" for g in range(SET_PASSES)]
    return rows.select("row", "text").mapInArrow(run, "node long, " + ", ".join(f"{c} array<long>" for c in columns))


def _plausible(a: Column, b: Column, percent: int) -> Column:
    """Sizes and sketches do not rule a pair out."""
    na, nb = a["n"], b["n"]
    apart = sum((F.bit_count(a["sketch"][i].bitwiseXOR(b["sketch"][i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(a["sketch"][0].bitwiseXOR(b["sketch"][0])))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two wide sketches differ, after folding one of twice the length; 0 if their lengths are further apart."""
    xor = lambda x, y: x.bitwiseXOR(y)
    length = F.least(F.size(a), F.size(b))
    folded = lambda x: F.when(F.size(x) > length, F.zip_with(F.slice(x, 1, length), F.slice(x, length + 1, length), xor)).otherwise(x)
    bits = F.aggregate(F.zip_with(folded(a), folded(b), xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    return F.when(F.greatest(F.size(a), F.size(b)) <= 2 * length, bits).otherwise(0)


def _verified(pairs: DataFrame, facts: DataFrame, texts: DataFrame, size: int, percent: int, scratch: common.Scratch, label: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written as ``label``. Sets are made of texts whose sizes and sketches allow a pair."""
    one, two = (facts.select(F.col("node").alias(c), F.struct("n", "sketch").alias(f"f{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    pairs = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(_plausible(F.col("fa"), F.col("fb"), percent))
    # ``room``: by how many shingles the rest of the two sets may differ
    room = F.floor((F.col("fa.n") + F.col("fb.n")) * (100 - percent) / (100 + percent))
    pairs = scratch.keep(pairs.where(_apart(F.col("wa"), F.col("wb")) <= room).select("a", "b", room.alias("room")), f"likely-{label}")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ends = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), f"ends-{label}")
    sets = scratch.keep(_sets(texts.join(ends.hint("merge"), "row", "left_semi"), size), f"sets-{label}")
    for turn in range(SET_PASSES):
        one, two = (sets.select(F.col("node").alias(c), F.col(f"shingles_{turn}").alias(f"s{c}")) for c in "ab")
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b")
        apart = F.size("sa") + F.size("sb") - 2 * F.size(F.array_intersect("sa", "sb"))
        both = both.select("a", "b", (F.col("room") - apart).alias("room")).where("room >= 0")
        pairs = scratch.keep(both, label if turn == SET_PASSES - 1 else f"{label}-part-{turn}")
    scratch.drop(f"likely-{label}", f"ends-{label}", f"sets-{label}", *[f"{label}-part-{turn}" for turn in range(SET_PASSES - 1)])
    return pairs.select("a", "b")


def _recurring(sketched: DataFrame, nodes: DataFrame, scratch: common.Scratch, turn: int) -> DataFrame:
    """key and node of the blocks of one pass (row, keys) that several nodes have."""
    # of all blocks only those that occur again go on, of these only the ones of nodes, and again those that recur
    blocks = sketched.select(F.explode("keys").alias("key"), F.col("row").alias("node"))
    again = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = scratch.keep(again(blocks), f"keys-{turn}")
    met = blocks.join(keys.hint("merge"), "key").join(nodes.select("node").hint("merge"), "node", "left_semi")
    met = scratch.keep(met, f"met-{turn}")
    keys = scratch.keep(again(met), f"keys-of-nodes-{turn}")
    shared = scratch.keep(met.join(keys.hint("merge"), "key"), f"shared-{turn}")
    scratch.drop(f"keys-{turn}", f"met-{turn}", f"keys-of-nodes-{turn}")
    return shared


def _placed(docs: DataFrame, scratch: common.Scratch, doc_id: str, text: str, size: int, percent: int, compared: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the numbered rows of ``docs`` as a struct, set size and component of every row number). ``compared``: of how many of its
    blocks, the lowest, a node is known to others when a pair looks for its first one; all, or fewer where texts have very many."""
    common.bounded_batches(docs.sparkSession)
    numbered = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    numbered = scratch.keep(numbered, "numbered", "zstd")
    texts = numbered.select("row", F.col(f"doc.{doc_id}").alias("doc_id"), F.col(f"doc.{text}").alias("text"))
    sketched = scratch.keep(_sketched(texts, size, percent), "sketched")
    named = scratch.keep(sketched.select("row", "doc_id", "n_shingles", "digest", "sketch", "wide"), "named")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    nodes = named.where("n_shingles > 0").groupBy("digest").agg(least)
    nodes = scratch.keep(nodes.select("digest", F.col("least.row").alias("node"), F.col("least.doc_id").alias("node_id")), "nodes")
    shared = [_recurring(sketched.select("row", F.col(f"keys_{g}").alias("keys")), nodes, scratch, g) for g in range(KEY_PASSES)]
    shared = reduce(DataFrame.unionByName, shared)
    scratch.drop("sketched")

    members = scratch.keep(shared.select(F.col("node").alias("row")).distinct(), "members")
    facts = named.select("row", F.col("n_shingles").alias("n"), "sketch", "wide").join(members.hint("merge"), "row", "left_semi")
    facts = scratch.keep(facts.withColumnRenamed("row", "node"), "facts")
    look = facts.select("node", F.struct("n", "sketch").alias("f"))

    links, roots, open_ = None, None, shared
    for turn in range(HUB_ROUNDS):
        pairs = scratch.keep(_hub_pairs(open_, roots, turn), f"hubs-{turn}")
        found = _verified(pairs, facts, texts, size, percent, scratch, f"links-{turn}")
        if turn > 1 and found.isEmpty():
            break  # what is open now are mostly pairs that no link joins
        links = found if links is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        roots = components.stars(links, scratch, f"stars-{turn}")
        open_ = scratch.keep(_open(open_, roots), f"open-{turn}")

    own = open_.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # a node's own blocks
    if compared:
        own = own.withColumn("keys", F.slice("keys", 1, compared))
    rooted = open_.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = scratch.keep(rooted.join(look, "node").join(own, "node"), "rooted")
    a, b = (rooted.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "f", "keys")]) for side in "ab")
    # a pair meets once, in the first block it shares, or in each of them if that is not among the blocks compared
    first = F.coalesce(F.array_min(F.array_intersect("keys_a", "keys_b")) >= F.col("key"), F.lit(True))
    crossing = a.join(b, "key").where("node_a < node_b and root_a <> root_b").where(_plausible(F.col("f_a"), F.col("f_b"), percent) & first)
    crossing = scratch.keep(crossing.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "crossing")
    found = _verified(crossing, facts, texts, size, percent, scratch, "links")
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
    roots = components.stars(links, scratch, "stars")

    # the node with the least row is a component's root; its least id has to be looked for among its nodes
    placed = nodes.join(roots, "node", "left").select("digest", "node", "node_id", F.coalesce("root", "node").alias("root"))
    leaders = placed.groupBy("root").agg(F.min(F.struct(F.col("node_id").isNull(), "node_id", "node")).alias("leader"))
    leaders = leaders.select("root", F.col("leader.node_id").alias("leader_id"), F.col("leader.node").alias("leader_row"))
    placed = scratch.keep(placed.select("digest", "root").join(scratch.keep(leaders, "leaders"), "root").drop("root"), "placed")
    scratch.drop("rooted", *[f"shared-{g}" for g in range(KEY_PASSES)], *[f"open-{turn}" for turn in range(HUB_ROUNDS)])
    alone = F.col("n_shingles") == 0
    return numbered, named.drop("sketch", "wide").join(placed, "digest", "left").select(
        "row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("leader_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("leader_row"))).alias("first"),
    )


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, and ``first`` (true for one row of each component).

    A set holds the distinct ``size``-word shingles, or the whole sequence of a shorter text. Null texts and texts
    without words have empty sets and are components of their own. ``component_id`` is the smallest id reachable by
    links; rows that repeat an id are separate members (null ids come last, and count only if there is no other).
    Other columns are left out. No rows give no rows.
    """
    scratch = common.Scratch(docs.sparkSession, "jaccard")
    return _placed(docs.select(doc_id, text), scratch, doc_id, text, size, percent)[1].drop("row")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
              scratch: common.Scratch | None = None) -> DataFrame:
    """The first row of each component, with all its columns; rows without words all stay.

    A caller that passes ``scratch`` can drop it once the result is written.
    """
    scratch = scratch or common.Scratch(docs.sparkSession, "jaccard")
    numbered, placed = _placed(docs, scratch, doc_id, text, size, percent, compared=16)
    return numbered.join(placed.where("first").select("row"), "row", "left_semi").select("doc.*")


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The blocks in which several components meet: no other block can hold a pair that still matters."""
    rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return shared.join(mixed, "key", "left_semi")


def _hub_pairs(shared: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """(a, b): each node and, of the hubs of its blocks outside its component, the one it shares most blocks with."""
    rooted = shared.withColumn("root", F.col("node"))
    if roots is not None:
        rooted = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
    hubs = rooted.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "root")).alias("hub"))
    met = rooted.join(hubs, "key").where(F.col("root") != F.col("hub.root"))
    counts = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
    best = counts.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("best"))
    return best.select(F.col("node").alias("a"), (-F.col("best.hub")).alias("b"))
