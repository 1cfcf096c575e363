"""Phrase collocation mining by stripes.

A prefix keys an associative counter of the words that follow it: its stripe. Tasks count stripes over their own texts
and emit them; stripes of one key are merged elementwise. A merged stripe answers three questions at once: which
extensions of the prefix are frequent, how often the prefix occurs (the sum of all counters, with one more for what ends a piece or is not counted;
a longer prefix has been counted as an extension before), and how much of the prefix its most frequent extension takes up.

Levels: single words are counted first, then stripes of prefixes of one word, of two and of three. A phrase is
at most as frequent as each part of it, so a level counts only extensions of which both parts, without the last and without the
first word, were left over by the level before. What is left over is
told to tasks by a bit filter of fixed size: false hits cost work and change nothing, as every count is exact. Most
stripes are short; the stripe of a prefix that holds a noticeable share of all words is split by a hash of the next word
into segments, so that none grows with the corpus alone. Stripes travel in bundles: a task's stripes (or segments) of about
``BUNDLE`` prefixes, chosen by hash, are one row of packed columns. So rows are few, however many prefixes there are, and a
merge holds one bundle at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bits of the filter of frequent phrases: 8 MB, whatever the corpus.
FILTER_BITS = 26
#: A prefix gets one segment for each 1 / SHARES of all words that it holds. So at most SHARES prefixes have several.
SHARES = 4096
#: Distinct words and distinct counters a task holds before it emits what it has.
WORDS_HELD, COUNTERS_HELD = 400_000, 2_000_000
#: Frequent prefixes to a bundle, and counters that a merge holds before it sums them up.
BUNDLE, MERGED = 256, 2_000_000
#: Salts of the first of two rankings.
SALTS = 64

_END = b"\xff"  # no byte of UTF-8 text
_FOLD = bytes(32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words_of(text: str) -> list[bytes]:
    """Words in order, with the mark _END between pieces."""
    return text.encode().translate(_FOLD).replace(_END, b" " + _END + b" ").split()


class Filter:
    """A set of phrases of a language, as bits. It may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1 + 6))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes * np.uint64(_SPREAD)) >> self.shift
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode()))


def filter_of(phrases: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of (lang, phrase) rows: at most 2^bits / 64 numbers reach the driver."""
    shift = 64 - bits

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashed = 0
                for word in phrase.encode().split(b" "):
                    hashed = (hashed * _STEP + word_hash(lang, word)) % (1 << 64)
                places.append((hashed * _SPREAD % (1 << 64)) >> shift)
            at = np.array(places, np.int64)
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(mask)], names=["at", "mask"])

    found = phrases.select("lang", "phrase").mapInArrow(place, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Filter(filled)


class Vocabulary:
    """A task's numbers for the words of one language, in order of appearance. _END is 0."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[_END]  # noqa: B018  (takes number 0)
        self.hashes = np.zeros(1, np.uint64)

    def read(self, texts: list[str]) -> np.ndarray:
        """The numbers of all words of the texts, each text ended by _END."""
        found = []
        for text in texts:
            words = words_of(text)
            words.append(_END)
            found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        return np.concatenate(found)

    def hashed(self) -> np.ndarray:
        """The hash of each word; that of _END means nothing."""
        if len(self.hashes) < len(self.numbers):
            new = list(self.numbers)[len(self.hashes):]
            self.hashes = np.append(self.hashes, np.array([word_hash(self.lang, w) for w in new], np.uint64))
        return self.hashes

    def names(self) -> pa.Array:
        names = list(self.numbers)
        names[0] = b""
        return pa.array(names, pa.binary()).cast(pa.string())


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[str]]]:
    for batch in batches:
        groups = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            groups[lang].append(text)
        yield groups


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of words; a row without a phrase has the number of all words."""
    held: dict[str, tuple[Vocabulary, np.ndarray]] = {}

    def emit():
        for lang, (vocabulary, counts) in held.items():
            names = pa.concat_arrays([pa.nulls(1, pa.string()), vocabulary.names()[1:]])
            counts[0] = counts[1:].sum()
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), names, pa.array(counts)], names=["lang", "phrase", "n"])
        held.clear()

    for groups in _by_language(batches):
        for lang, texts in groups.items():
            vocabulary, counts = held.get(lang) or (Vocabulary(lang), np.zeros(0, np.int64))
            found = np.bincount(vocabulary.read(texts), minlength=len(vocabulary.numbers))
            found[: len(counts)] += counts
            held[lang] = vocabulary, found
        if sum(len(v.numbers) for v, _ in held.values()) > WORDS_HELD:
            yield from emit()
    yield from emit()


def _summed(columns: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in order, and the sums of ``times``."""
    if not len(times):
        return columns, times
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[starts] for c in columns], np.add.reduceat(times[order], starts)


class Stripes:
    """A task's counters of one language. A counter is the prefix's words (1, 2 or 3), then the next word, as two numbers;
    a next word of 0 stands for the end of a piece and for words that no frequent phrase goes on with."""

    def __init__(self, lang: str, hot: dict[str, dict[str, int]], bundles: dict[str, int], limit: int):
        self.vocabulary, self.hot, self.bundles = Vocabulary(lang), hot.get(lang, {}), bundles.get(lang, 1)
        self.held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, prefix: list[np.ndarray], following: np.ndarray) -> None:
        one, two, three = [*prefix, *[np.zeros(1, np.int64)] * (3 - len(prefix))]
        columns = [one << 32 | np.broadcast_to(two, one.shape), np.broadcast_to(three << 32, one.shape) | following]
        self.held.append(_summed(columns, np.ones(len(one), np.int64)))
        self.size += len(self.held[-1][1])
        if self.size > self.limit:
            self.compact()

    def compact(self) -> None:
        if self.held:
            columns = [np.concatenate([c[k] for c, _ in self.held]) for k in (0, 1)]
            self.held = [_summed(columns, np.concatenate([n for _, n in self.held]))]
            self.size = len(self.held[0][1])

    def emit(self) -> Iterator[pa.RecordBatch]:
        """One row per bundle: lang, bundle, and the packed prefixes, segments, rests, numbers of words, words and counters."""
        self.compact()
        if not self.size:
            return
        (first, second), times = self.held[0]
        names, hashes = self.vocabulary.names(), self.vocabulary.hashed()
        words = [first >> 32, first & 0xFFFFFFFF, second >> 32]
        following = second & 0xFFFFFFFF
        starts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (words[2][1:] != words[2][:-1])))
        prefix = names.take(pa.array(words[0][starts]))
        place = hashes[words[0][starts]]
        for k in (1, 2):
            longer = pc.binary_join_element_wise(prefix, names.take(pa.array(words[k][starts])), " ")
            prefix = pc.if_else(pa.array(words[k][starts] > 0), longer, prefix)
            place = np.where(words[k][starts] > 0, place * np.uint64(_STEP) + hashes[words[k][starts]], place)
        stripe = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(times))))
        segment = np.zeros(len(times), np.uint64)
        if self.hot:
            parts = np.array([self.hot.get(key, 1) for key in prefix.to_pylist()], np.uint64)[stripe]
            segment = np.where(following > 0, ((hashes[following] * np.uint64(_SPREAD)) >> np.uint64(20)) % parts, np.uint64(0))
        bundle = (((place[stripe] + segment) * np.uint64(_SPREAD)) >> np.uint64(16)) % np.uint64(self.bundles)
        order = np.lexsort((following, segment, stripe, bundle))
        bundle, stripe, segment, following, times = (x[order] for x in (bundle, stripe, segment, following, times))
        cuts = np.flatnonzero(np.append(True, (stripe[1:] != stripe[:-1]) | (segment[1:] != segment[:-1])))
        rows = np.flatnonzero(np.append(True, bundle[cuts][1:] != bundle[cuts][:-1]))  # stripes at which a bundle begins
        is_rest = following == 0
        lengths = np.add.reduceat((~is_rest).astype(np.int64), cuts)
        ends = np.append(0, np.cumsum(lengths))
        stripe_offsets = np.append(rows, len(cuts)).astype(np.int64)
        entry_offsets = ends[stripe_offsets]
        joined = lambda values, offsets, sep: pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), sep)
        columns = {
            "lang": pa.repeat(self.vocabulary.lang, len(rows)), "bundle": pa.array(bundle[cuts][rows].astype(np.int64)),
            "prefixes": joined(prefix.take(pa.array(stripe[cuts])), stripe_offsets, "\n"),
            "segments": _packed(segment[cuts], stripe_offsets, "<u4"),
            "rests": _packed(np.add.reduceat(np.where(is_rest, times, 0), cuts), stripe_offsets, "<u4"),
            "lengths": _packed(lengths, stripe_offsets, "<u4"),
            "nexts": joined(names.take(pa.array(following[~is_rest])), entry_offsets, " "), "counts": _packed(times[~is_rest], entry_offsets, "<u4"),
        }
        whole = pa.RecordBatch.from_pydict(columns)
        for start in range(0, len(whole), 64):
            yield whole.slice(start, 64)


def _packed(values: np.ndarray, offsets: np.ndarray, kind: str) -> pa.Array:
    """Runs of numbers as bytes. A task counts fewer words than 32 bits can."""
    data = values.astype(kind)
    at = pa.py_buffer((offsets * data.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(data.tobytes())])


def _unpacked(row: dict) -> pa.Table:
    """The stripes of a bundle as rows: prefix, segment, rest, nexts, counts."""
    segments, rests, lengths, counts = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("segments", "rests", "lengths", "counts"))
    offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
    words = pa.array(row["nexts"].split(" ") if len(counts) else [], pa.string())
    return pa.table({
        "prefix": pa.array(row["prefixes"].split("\n"), pa.string()), "segment": segments, "rest": rests,
        "nexts": pa.ListArray.from_arrays(offsets, words), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts)),
    })


def _count_stripes(known, hot, size: int, limit: int):
    """Stripes of prefixes of ``size`` - 1 words, with a filter of the frequent phrases of as many words. Only those of
    single words have a rest: how often longer ones occur is known from the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, (many, bundles) = known.value, hot.value
        held: dict[str, Stripes] = {}
        for groups in _by_language(batches):
            for lang, texts in groups.items():
                own = held.get(lang) or held.setdefault(lang, Stripes(lang, many, bundles, limit))
                ids = np.append(own.vocabulary.read(texts), np.zeros(size, np.int64))
                hashes = own.vocabulary.hashed()
                n = len(ids) - size + 1
                phrase, whole = hashes[ids[:n]], ids[:n] > 0
                for k in range(1, size - 1):
                    phrase = phrase * np.uint64(_STEP) + hashes[ids[k : n + k]]
                    whole &= ids[k : n + k] > 0
                whole &= frequent.has(phrase)
                at = np.flatnonzero(whole[:-1] if size == 2 else whole[:-1] & whole[1:])
                following = np.where(whole[at + 1], ids[at + size - 1], 0)
                own.add([ids[at + k] for k in range(size - 1)], following)
            if sum(s.size for s in held.values()) > limit or sum(len(s.vocabulary.numbers) for s in held.values()) > WORDS_HELD:
                for own in held.values():
                    yield from own.emit()
                held.clear()
        for own in held.values():
            yield from own.emit()

    return run


def merged_stripes(table: pa.Table) -> pa.Table:
    """Stripes of one key (prefix, segment) merged elementwise."""
    prefixes = pc.dictionary_encode(table["prefix"].combine_chunks()).indices.to_numpy().astype(np.int64)
    _, starts, row = np.unique(prefixes << 32 | table["segment"].to_numpy(), return_index=True, return_inverse=True)
    nexts, counts = table["nexts"].combine_chunks(), table["counts"].combine_chunks()
    words = pc.dictionary_encode(nexts.flatten())
    owner = np.repeat(row, pc.list_value_length(nexts).to_numpy())
    (owner, word), times = _summed([owner, words.indices.to_numpy().astype(np.int64)], counts.flatten().to_numpy())
    offsets = pa.array(np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32))
    rest = np.zeros(len(starts), np.int64)
    np.add.at(rest, row, table["rest"].to_numpy())
    return pa.table({
        "prefix": table["prefix"].take(pa.array(starts)), "segment": table["segment"].take(pa.array(starts)), "rest": pa.array(rest),
        "nexts": pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(word))),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(times)),
    })


def _merge(least: int, limit: int):
    """Merge the stripes of each bundle; of a merged stripe its total and the frequent extensions are kept."""

    def pruned(lang: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        counts = table["counts"].combine_chunks()
        times, lengths = counts.flatten().to_numpy(), pc.list_value_length(counts).to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        total = table["rest"].to_numpy().copy()
        np.add.at(total, row, times)
        on = times >= least
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[on], minlength=len(lengths)))).astype(np.int32))
        nexts = table["nexts"].combine_chunks().flatten().filter(pa.array(on))
        made = pa.table({
            "lang": pa.repeat(lang, len(total)), "prefix": table["prefix"], "total": pa.array(total),
            "nexts": pa.ListArray.from_arrays(offsets, nexts), "counts": pa.ListArray.from_arrays(offsets, pa.array(times[on])),
        })
        yield from made.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["lang"], row["bundle"]):
                    if waiting:
                        yield from pruned(key[0], merged_stripes(pa.concat_tables(waiting)))
                    key, waiting, size = (row["lang"], row["bundle"]), [], 0
                waiting.append(_unpacked(row))
                size += len(row["counts"]) // 4
                if size > limit:
                    waiting, size = [merged_stripes(pa.concat_tables(waiting))], 0
        if waiting:
            yield from pruned(key[0], merged_stripes(pa.concat_tables(waiting)))

    return run


def _hot(phrases: DataFrame, sizes: DataFrame) -> dict[str, dict[str, int]]:
    """Segments of the prefixes that need several: at most SHARES rows a language, as each holds that share of its words."""
    found = phrases.join(sizes, "lang").where(F.col("f") * SHARES > F.col("n")).select("lang", "phrase", F.ceil(F.col("f") * SHARES / F.col("n")).alias("parts"))
    hot = defaultdict(dict)
    for row in found.collect():
        hot[row["lang"]][row["phrase"]] = int(row["parts"])
    return dict(hot)


def _level(rows: DataFrame, frequent: DataFrame, sizes: DataFrame, size: int, least: int, scratch: common.Scratch) -> DataFrame:
    """Merged stripes (lang, prefix, total, nexts, counts) of the prefixes in ``frequent`` (lang, phrase, f), written."""
    spark = rows.sparkSession
    counted = frequent.groupBy("lang").agg(F.ceil(F.count("*") / BUNDLE).alias("bundles")).collect()  # a number for each language
    known = spark.sparkContext.broadcast(filter_of(frequent))
    hot = spark.sparkContext.broadcast((_hot(frequent, sizes), {r["lang"]: int(r["bundles"]) for r in counted}))
    packed = "segments binary, rests binary, lengths binary, nexts string, counts binary"
    stripes = rows.mapInArrow(_count_stripes(known, hot, size, COUNTERS_HELD), f"lang string, bundle long, prefixes string, {packed}")
    keys = ["lang", "bundle"]
    merged = stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(least, MERGED), "lang string, prefix string, total long, nexts array<string>, counts array<long>")
    return scratch.keep(merged.where((F.size("nexts") > 0) | F.lit(size == 2)), f"stripes-{size}")


def _joined(first, last):
    return F.array_join(F.slice("w", first, last), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 4, least: int = 30, keep_percent: int = 80,
                 scratch: common.Scratch | None = None) -> DataFrame:
    """Candidate phrases of two to ``longest`` (at most 4) words: lang, phrase, a, l, r, n, score, dropped.

    Words and pieces are those of ``words_of``; phrases lie within a piece. ``a`` is how often the phrase occurs, ``least`` at least; ``l`` and
    ``r`` belong to the cut with the lowest score floor(2000000 * a / (l + r)), the first one of equals; ``n`` counts all
    words of the language. ``dropped``: a longer candidate holds the phrase, with at least ``keep_percent`` % of its
    occurrences. A null language is ``und``, a null text empty. Repeated rows count each; other columns are not read. No rows, or
    no frequent phrase, give no rows. A caller that passes ``scratch`` can drop it once the result is written.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = scratch or common.Scratch(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    words = rows.mapInArrow(_count_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = scratch.keep(words.where(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    sizes = words.where("phrase is null").select("lang", F.col("f").alias("n"))
    frequent, levels, found = words.where("phrase is not null"), [], []
    for size in range(2, longest + 1):
        levels.append(_level(rows, frequent, sizes, size, least, scratch))
        extended = levels[-1].select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
        phrase = F.concat_ws(" ", "prefix", "e.nexts")
        frequent = scratch.keep(extended.select("lang", phrase.alias("phrase"), F.col("e.counts").alias("f"), F.split(phrase, " ").alias("w")), f"found-{size}")
        found.append(frequent)
    totals = levels[0].groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"))
    parts = reduce(DataFrame.unionByName, [totals, *[f.drop("w") for f in found[:-1]]])
    most = F.max(F.array_max("counts")).alias("right_most")
    right = reduce(DataFrame.unionByName, levels).groupBy("lang", F.col("prefix").alias("phrase")).agg(most)
    found = reduce(DataFrame.unionByName, found).withColumnRenamed("f", "a")

    # what a phrase is the rest of; a phrase inside a longer candidate of two words more lies in one of one word more, too
    left = found.where(F.size("w") > 2).groupBy("lang", _joined(2, F.size("w") - 1).alias("phrase")).agg(F.max("a").alias("left_most"))
    cut = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.lit(1), F.col("k")).alias("first"), _joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("last"))
    known = lambda name, count: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(known("first", "l"), ["lang", "first"]).join(known("last", "r"), ["lang", "last"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest)
    covered = F.coalesce(F.greatest("left_most", "right_most"), F.lit(0)).cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * keep_percent
    out = scored.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left").join(sizes, "lang")
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"), covered.alias("dropped"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language that are not dropped, with their rank; first within salts, then among what
    those leave, so that no task ranks all phrases of a language. ``top`` is the feature, not a cap on work."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.where(~F.col("dropped")).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    final = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return final.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
